"""The pipeline on a small corpus, stage by stage."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from porelith.llm import mixing, pieces, quality_rules, queries, toxicity

from .conftest import prose
from .test_table_operators import brute_targets, edited, jaccard, multiset
from .test_text_operators import brute_counts, brute_features


def corpus(spark, path):
    docs, labels = [], []
    for k in range(240):
        bad, junk = k % 8 == 0, k % 8 == 1
        t = prose(k, 90)
        t = " ".join(t.split()[:60] + ["rottenword"] * 4 + t.split()[60:]) if bad else "### " + " ### ".join(t.split()) if junk else t
        docs.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, int(not junk), int(bad)))
    docs += [(1000 + k, docs[2][1], "en", "s0", 0) for k in range(5)] + [(2000, None, None, None, None), (2001, "short text", "en", "s1", 10)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert not any(k % 8 == 0 for k in ids("toxicity") if k < 240) and 2000 in ids("toxicity")
    assert len([k for k in ids("toxicity") if k < 240]) == 210
    assert 2000 not in ids("quality_rules") and 2001 not in ids("quality_rules")
    assert 2 in ids("near_duplicates") and not ids("near_duplicates") & set(range(1000, 1005))
    assert len(seen["near_duplicates"]) == len(ids("near_duplicates"))
    assert max(Counter(r["doc_id"] for r in seen["mixing"]).values()) <= 3
    text = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    codec = pieces.PieceTable.load(pieces.default_model()).codec()
    assert len(seen["pieces"]) == len(seen["mixing"])
    assert all(r["exact"] and codec.decode(r["ids"]) == text[r["doc_id"]] for r in seen["pieces"])


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def brute_mix(rows):
    """Copies of each row (id, text, source), in order, by one walk along every source."""
    seen, by, sizes = Counter(), defaultdict(list), Counter()
    for at, (k, t, s) in enumerate(rows):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        row = f"{'' if k is None else k}|{'n' if s is None else 's' + s}|{hashlib.md5((t or '').encode()).hexdigest()}"
        unit = int(hashlib.md5(f"{mixing.SEED}|{row}|{seen[row]}".encode()).hexdigest()[:13], 16) / 2**52
        seen[row] += 1
        bits = (size + 1).bit_length()
        by[s].append((bits * 8 + ((size + 1) >> max(bits - 3, 0)), unit, k, at))
        sizes[s] += size
    goal = brute_targets({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s))})
    copies = [0] * len(rows)
    for s, members in by.items():
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        offset = int(hashlib.md5(f"{mixing.SEED}|offset|{s or ''}".encode()).hexdigest()[:13], 16) / 2**52
        for place, (*_, at) in enumerate(sorted(members)):
            copies[at] = math.floor((place + 1) * rate + offset) - math.floor(place * rate + offset)
    return copies


def brute_cutoffs(rows, good):
    """{lang: {rule: cutoff}} from (id, text, lang) that pass the base and have a label, every tail summed term by term."""
    tail = lambda k, n: math.fsum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
    groups = defaultdict(lambda: ([], []))
    for k, t, lang in rows:
        if k in good:
            groups[lang][0 if good[k] else 1].append(brute_shares(t))
    groups = {s: g for s, g in groups.items() if len(g[0]) >= quality_rules.least_good()}
    alpha = 0.05 / max(1, 2 * len(groups) * 3 * len(quality_rules.GRID))
    out = {}
    for s, (yes, no) in groups.items():
        for r in range(3):
            for cut in sorted(quality_rules.GRID):
                beyond = [sum(x[r] > cut for x in xs) for xs in (yes, no)]
                if tail(beyond[0], len(yes)) <= alpha and beyond[1] and 1 - tail(beyond[1] - 1, len(no)) <= alpha:
                    out.setdefault(s, {})[r] = cut
                    break
    return out


def brute_shares(text):
    words, chars, symbols, again, covered, lines = brute_counts(text)
    return 1000 * symbols // max(chars, 1), 1000 * covered // max(words, 1), 1000 * again // max(lines, 1)


def test_every_stage_matches_brute_force(spark, tmp_path):
    r = random.Random(21)
    docs, labels = [], []
    for k in range(1700):
        bad, junk = k % 13 == 0, k % 7 == 1
        words = prose(k, r.randrange(45, 80)).split()
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["rottenword", "nitwitty", "N1TW1TTY"]))
        if junk:
            words = [x for w in words for x in (w, "#$#")]
        docs.append((3 * k, " ".join(words), ("aa", "aa", "aa", "bb")[k % 4], ("s0", "s1", "s2", None)[r.choice((0, 0, 0, 1, 2, 3))], None))
        if k % 50:
            labels.append((3 * k, int(not junk), int(bad)))
    for k in range(60):  # exact and near copies
        i, t, lang, s, _ = docs[r.randrange(len(docs))]
        docs.append((10_000 + k, edited(t, k % 3, r), lang, s, 1))
    docs += [(20_000, None, None, None, None), (20_001, "", "aa", "s0", 0)]
    r.shuffle(docs)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon = toxicity.train(toxicity.training_rows(table), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = lexicon.curve.predict(np.array([brute_features(lexicon, d[1]) for d in docs]))
    want = {"toxicity": [d for d, x in zip(docs, scores, strict=True) if x < 0.7]}

    good = {k: bool(q) for k, q, _ in labels}
    passed = [d for d in want["toxicity"] if (c := brute_counts(d[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    cuts = brute_cutoffs([d[:3] for d in passed], good)
    assert cuts, "some rule must bite"
    want["quality_rules"] = [d for d in passed if all(brute_shares(d[1])[rule] <= cut for rule, cut in cuts.get(d[2], {}).items())]
    classes = brute_classes_sparse([(d[0], d[1]) for d in want["quality_rules"]])
    want["near_duplicates"] = [d for d in want["quality_rules"] if classes[d[0]] == d[0]]
    copies = brute_mix([(d[0], d[1], d[3]) for d in want["near_duplicates"]])
    want["mixing"] = [d for d, n in zip(want["near_duplicates"], copies, strict=True) for _ in range(n)]

    got = table
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, str(tmp_path))
        got.write.parquet(f"{tmp_path}/out-{name}")
        got = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name in want:
            assert Counter(map(tuple, got.collect())) == Counter(want[name]), name
    codec = pieces.PieceTable.load(pieces.default_model()).codec()
    encoded = {d[0]: codec.encode(d[1]) for d in want["mixing"]}
    assert Counter((x["doc_id"], tuple(x["ids"])) for x in got.collect()) == Counter((d[0], tuple(encoded[d[0]])) for d in want["mixing"])
    assert all(len(a) > len(b) for a, b in zip([docs, *want.values()], list(want.values())[:3]))


def brute_classes_sparse(rows):
    """Class of each id: least id over links of 0.8 and more, looked for among texts that share a window."""
    sets = [multiset(t) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for w in s for j in holders[w]}:
            if jaccard(s, sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for w in s:
            holders[w].append(i)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return {k: min(least[find(i)]) for i, (k, _) in enumerate(rows)}

"""Toxicity, language, quality rules and pieces: against brute force, on odd input and held out."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from porelith.llm import common, language_id, pieces, quality_rules, toxicity
from porelith.llm.textblocks import blocks

from .conftest import ODD


def one(texts):
    (found,) = [b for _, _, b in blocks(pa.array(texts, pa.string()), 2**40)]
    return found


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#é漢\x0b\x85 ", max_size=60)), min_size=1, max_size=6))
def test_counts_match_brute_force(texts):
    got = quality_rules.count_block(one(texts))
    assert list(zip(*(got[c].tolist() for c in quality_rules.COUNTS), strict=True)) == [brute_counts(t) for t in texts]


def test_blocks_cut_between_texts():
    texts = ["abc def"] * 10 + [None, "", "x" * 100]
    cut = list(blocks(pa.array(texts)[2:], 20))
    assert cut[0][0] == 0 and cut[-1][1] == 11
    assert [b.text(i) for _, _, b in cut for i in range(b.n)] == [(t or "").encode() for t in texts[2:]]


def test_binomial_bound_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5), (-1, 5, 0.3), (0, 700, 0.01), (9, 700, 0.01), (290, 300, 0.99), (60, 300, 0.3)):
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    began = time.perf_counter()
    assert 0.49 < quality_rules.binomial_cdf(10**7, 10**9, 0.01) < 0.51 and time.perf_counter() - began < 0.1


def test_strata_too_small_for_any_proof_are_silent(spark):
    least = quality_rules.least_good()
    one_test = 0.05 / (2 * len(quality_rules.RULES) * len(quality_rules.GRID))
    assert 0.99**least <= one_test < 0.99 ** (least - 1)
    zero = dict.fromkeys(quality_rules.COUNTS, 0) | {"word_chars": 500, "n_words": 60, "n_lines": 1}
    rows = [(s, y, *(zero | {"n_symbols": 0 if y else 100}).values()) for s, n in (("big", 1000), ("small", least - 1)) for y in (True, False) for _ in range(n)]
    rated = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{c} bigint" for c in zero))
    found = quality_rules.calibrate(rated)
    assert found == {"big": {"symbols": quality_rules.GRID[0]}}
    judged = rated.withColumn("kept", quality_rules.verdict(found, F.col("stratum")))
    assert judged.where("kept != (good or stratum = 'small')").count() == 0


def test_cutoffs_limit_false_rejections():
    base = {f"{p}_{r}_{g}": 0 for p in "gb" for r in quality_rules.RULES for g in quality_rules.GRID}
    strong = base | {f"b_symbols_{g}": 200 for g in quality_rules.GRID}
    useful = quality_rules.cutoffs_of([{"s": "x", "n": 2000, "b": 300} | strong], 0.01, 0.05)
    assert useful["x"] == {"symbols": quality_rules.GRID[0]}
    noisy = strong | {f"g_symbols_{g}": 15 for g in quality_rules.GRID[:3]}
    assert quality_rules.cutoffs_of([{"s": "x", "n": 2000, "b": 300} | noisy], 0.01, 0.05)["x"] == {"symbols": quality_rules.GRID[3]}
    assert quality_rules.cutoffs_of([{"s": "x", "n": 200, "b": 300} | strong], 0.01, 0.05)["x"] == {}


def test_quality_rules_odd_and_empty(spark, odd, none, labels):
    rows = quality_rules.quality_rules(odd, labels).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, *brute_counts(t)[:5]) for i, t, _, _ in ODD)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    assert all(not r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(odd, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_rules_learn_from_labels(spark):
    rows = [(i, ("### $$$ word%d " % i) * 60 if i % 5 == 0 else " ".join(f"word{i}x{j}" for j in range(60)), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(1500)], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(docs, marks)
    assert got.where("kept and doc_id % 5 = 0").count() == 0
    assert got.where("not kept and doc_id % 5 != 0").count() == 0


# -- toxicity
def toxic_corpus(n, seed=0):
    r = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    texts, marks = [], []
    for i in range(n):
        ws = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            ws[r.randrange(len(ws))] = r.choice(["grumbler", "nitwitty", "rotten"])
        texts.append(" ".join(ws))
        marks.append(int(bad))
    return texts, marks


def test_lexicon_is_learned_and_folded():
    lexicon = toxicity.learn(*toxic_corpus(400))
    score = lambda *t: lexicon.scores(one(list(t)))
    clean = "word1 word2 word3 word4 word5 word6 word7 word8"
    assert {w.strip()[:5] for w in lexicon.weights} == {"grumb", "nitwi", "rotte"}
    hits = score(*(f"{clean} {w} {clean}" for w in ("grumbler", "GRUMBLER", "gгumbІеr", "9rumb1er", "ｇｒｕｍｂｌｅｒ", "gr​umbler", "n!tw1tty", "r0tten")))
    assert (hits > 0.7).all()
    assert (score(clean, "", None, "2009 $$$ !!!") < 0.3).all()


def test_exceptions_spare_terms():
    texts, marks = toxic_corpus(400)
    lexicon = toxicity.learn(texts, marks, ("rotten apples",))
    pure = "word1 word2 word3"
    a, b, c = lexicon.scores(one([f"{pure} rotten apples {pure}", f"{pure} rotten pears {pure}", f"{pure} rotten apples and rotten pears {pure}"]))
    assert a < 0.3 < 0.7 < b and c > 0.7


def test_matches_equal_a_plain_search():
    lexicon = toxicity.Lexicon({" abc": 1.0, " bca": 2.0}, ())
    r = random.Random(3)
    for _ in range(200):
        s = "".join(r.choice("abc  ") for _ in range(30))
        folded = lexicon.ready()[0].text(s)
        want = sorted((m.start(), t) for k, t in ((" abc", 0), (" bca", 1)) for m in re.finditer(f"(?={re.escape(k)})", folded))
        assert sorted(zip(*(x.tolist() for x in lexicon.matches(folded)), strict=True)) == want


def brute_features(lexicon, text):
    """Features of one text by plain searches, all exceptions against all matches."""
    folded = lexicon.ready()[0].text(text or "")
    phrases = {lexicon.ready()[0].text(x) for x in lexicon.exceptions}
    spans = [(m.start(), m.start() + len(p)) for p in phrases for m in re.finditer(f"(?={re.escape(p)})", folded)]
    hits = [t for t in lexicon.weights for m in re.finditer(f"(?={re.escape(t)})", folded) if not any(a <= m.start() and m.start() + len(t) <= b + 1 for a, b in spans)]
    total, words = sum(lexicon.weights[t] for t in hits), len(folded.split())
    return [math.log1p(total), min(100 * total / max(words, 1), 50), math.log1p(len(set(hits))), math.log1p(words) * (total > 0), float(total > 0)]


def test_scores_match_brute_force_in_any_order():
    lexicon = toxicity.learn(*toxic_corpus(400), ("rotten apples", "trash can"))
    r = random.Random(4)
    some = ["rotten", "apples", "r0tten", "grumbler", "ni!twitty", "trash", "can", "word1", "ab!", "!", "c", "\u200b", "été", "", " "]
    texts = [" ".join(r.choice(some) for _ in range(r.randrange(12))) for _ in range(300)] + [None, "", "rotten", "apples rotten", "apples"]
    want = lexicon.curve.predict(np.array([brute_features(lexicon, t) for t in texts]))
    for _ in range(5):
        order = list(range(len(texts)))
        r.shuffle(order)
        np.testing.assert_allclose(lexicon.scores(one([texts[k] for k in order])), want[order])


def test_phrases_do_not_cross_the_border_of_texts():
    lexicon = toxicity.Lexicon({" tras": 3.0}, ("trash can",))
    alone = lexicon.features(one(["you are trash"]))
    np.testing.assert_array_equal(lexicon.features(one(["you are trash", "can openers here"]))[:1], alone)
    assert alone[0, 4] == 1 and lexicon.features(one(["you are trash can"]))[0, 4] == 0
    lexicon = toxicity.Lexicon({" abic": 3.0}, ())
    assert lexicon.features(one(["ab!", "c"]))[:, 4].sum() == 0 and lexicon.features(one(["ab!c"]))[0, 4] == 1


def test_many_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({" tras": 3.0}, ("trash can",))
    text = "trash can trash bag " * 100_000
    began = time.perf_counter()
    at, _ = lexicon.matches(lexicon.ready()[0].text(text))
    assert len(at) == 100_000 and time.perf_counter() - began < 5


def test_training_on_one_id(spark):
    texts, marks = toxic_corpus(400)
    docs = spark.createDataFrame([(7 + m, t) for t, m in zip(texts, marks, strict=True)] * 2 + [(None, "x")], "doc_id bigint, text string")
    lab = spark.createDataFrame([(7, 0), (8, 1)], "doc_id bigint, toxic int")
    few = toxicity.train(docs, lab, rows=300)
    assert {w.strip()[:5] for w in few.weights} == {"grumb", "nitwi", "rotte"}
    assert len(common.lowest(docs.where("doc_id is not null").distinct(), ["doc_id", "text"], 100)) == 100


def test_toxicity_odd_and_empty(spark, odd, none, labels):
    lexicon = toxicity.train(odd, labels)
    rows = toxicity.scored(odd, lexicon).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(none, lexicon).count() == 0
    empty = toxicity.train(none, labels)
    assert toxicity.scored(odd, empty).count() == len(ODD)


def test_toxicity_held_out(spark):
    texts, marks = toxic_corpus(900)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id bigint, toxic int")
    scored = toxicity.scored(docs, toxicity.train(toxicity.training_rows(docs), lab)).collect()
    assert np.mean([(r["score"] >= 0.7) == bool(marks[r["doc_id"]]) for r in scored]) > 0.99


# -- language
def brute_tree(texts, most=10**9):
    """Counts by context (a tuple) of the ``most`` contexts that most bytes followed."""
    counts = {}
    for t in texts:
        padded = [256] * 3 + list(t)  # the start of a text comes last among the symbols
        for i in range(3, len(padded)):
            for o in range(4):
                counts.setdefault(tuple(padded[i - o : i]), Counter())[padded[i]] += 1
    ranked = sorted(counts, key=lambda c: (-sum(counts[c].values()), len(c), c))
    return {c: counts[c] for c in ranked[:most]}


def brute_bits(tree, text):
    """Code length in one language by walking counts, escape by escape."""
    total, padded = 0.0, [256] * 3 + list(text)
    for i in range(3, len(padded)):
        p = 1.0
        for o in (3, 2, 1, 0):
            c = tree.get(tuple(padded[i - o : i]))
            if c is None:
                continue
            n, kinds = sum(c.values()), len(c)
            if padded[i] in c:
                p *= c[padded[i]] / (n + kinds)
                break
            p *= kinds / (n + kinds)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_and_predictions_match_brute_force():
    texts = {"a": [b"the cat sat", b"on the mat", b"x"], "b": ["der hünd saß".encode(), b"auf"], "c": [b"el gato en la mesa"]}
    asked = ["the hat", "", "hünd", "zzz\x00", "a", "on", "the mat the mat the", "la gata", "12 34", None]
    for most in (10**9, 60, 9):
        trees = language_id.ByteTrees(texts, most)
        kept = {x: brute_tree(ts, max(1, most // 3)) for x, ts in texts.items()}
        assert len(trees.table) == trees.size * sum(1 + len(k) for k in kept.values())
        want = np.array([[brute_bits(kept[x], (t or "").encode()) for x in "abc"] for t in asked])
        np.testing.assert_allclose(trees.bits(one(asked)), want, rtol=1e-5)
        lang, score = trees.predict(one(asked))
        odds = 2.0 ** -(want - want.min(1, keepdims=True))
        letter = [any(c.isalpha() for c in t or "") for t in asked]
        assert lang == ["abc"[w.argmin()] if ok else "und" for w, ok in zip(want, letter, strict=True)]
        np.testing.assert_allclose(score, np.where(letter, odds.max(1) / odds.sum(1), 0), rtol=1e-4)


def test_the_model_is_bounded_in_languages():
    r = random.Random(1)
    sizes = []
    for n in (4, 32):
        texts = {f"l{k}": [bytes(r.randrange(256) for _ in range(20_000))] for k in range(n)}
        trees = language_id.ByteTrees(texts, 4096)
        assert len(trees.table) <= trees.size * (4096 + n) and trees.own.shape[1] <= 4097
        sizes.append(len(trees.table))
    assert sizes[1] <= 1.1 * sizes[0]


def test_training_on_repeated_and_null_ids(spark):
    rows = [(None if k % 2 else 7, ("the cat sat on mat " if k % 3 else "der hund lief weg ") + str(k), "en" if k % 3 else "de") for k in range(600)]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string")
    trees = language_id.train(docs, docs_each=50)
    assert trees.langs == ["de", "en"]
    assert trees.predict(one(["the cat lay", "ein hund"]))[0] == ["en", "de"]
    same = spark.createDataFrame([(7, "gleich und gleich", "de")] * 500, docs.schema)
    assert language_id.train(same, docs_each=5).langs == ["de"]


def test_long_texts_are_coded_in_slices(monkeypatch):
    trees = language_id.ByteTrees({"a": [b"the cat sat on the mat"], "b": [b"der hund"]})
    text = ["the cat and der hund " * 20]
    whole = trees.bits(one(text))
    monkeypatch.setattr(language_id, "SLICE", 7)
    np.testing.assert_allclose(trees.bits(one(text)), whole, rtol=1e-6)


def test_language_odd_and_empty(spark, odd, none):
    trees = language_id.train(odd)
    rows = language_id.identify(odd, trees).collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"]): r for r in rows}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == by[11]["lang_pred"] == "und"
    assert by[3]["score"] == 0 and by[1]["lang_pred"] == "en"
    assert language_id.identify(none, trees).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}


# -- pieces
@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable.load(pieces.default_model())


def best_by_lattice(table, s, longest=20):
    index = {p: i for i, (p, k) in enumerate(zip(table.pieces, table.kinds, strict=True)) if k == "n"}
    low = min(sc for sc, k in zip(table.scores, table.kinds, strict=True) if k == "n") - pieces.UNKNOWN_PENALTY
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(max(0, e - longest), e):
            w = s[a:e]
            if w in index:
                best[e] = max(best[e], best[a] + table.scores[index[w]])
            elif len(w) == 1:
                best[e] = max(best[e], best[a] + low)
    return best[-1]


def score(table, codec, ids, s):
    """Score of a path; characters spelled in bytes count as unknown."""
    low = codec.unknown_score
    known = sum(table.scores[i] for i in ids if table.kinds[i] == "n")
    spelled = codec.decode([i for i in ids if table.kinds[i] == "b"])
    return known + low * len(spelled)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="the and▁ö漢é😀x#$\n", max_size=25))
def test_round_trip_and_best_score(table, text):
    codec = table.codec()
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    if text and pieces.SPACE not in text:
        s = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert score(table, codec, ids, s) == pytest.approx(best_by_lattice(table, s))


def test_whole_text_path_equals_word_paths(table):
    codec = table.codec()
    r = random.Random(1)
    for _ in range(50):
        s = " ".join("".join(r.choice("thenadosi") for _ in range(r.randrange(1, 9))) for _ in range(12))
        whole = codec.best(pieces.SPACE + s.replace(" ", pieces.SPACE))
        assert list(whole) == codec.encode(s)


def test_tables_with_spaces_inside_pieces():
    t = pieces.PieceTable(["<unk>", "▁", "a", "b", "▁a▁b", "a▁"], [0, -2.0, -1.0, -1.0, -1.5, -1.2], "unnnnn")
    codec = t.codec()
    assert not codec.by_word
    assert codec.encode("a b") == [4] and codec.encode("aa") == [1, 2, 2]
    assert codec.decode(codec.encode("a b a")) == "a b a"


def test_library_agrees_on_score(table):
    """The library's best path over the same pieces scores the same; its model type is switched to unigram."""
    import sentencepiece

    raw = open(pieces.default_model(), "rb").read()
    at = raw.rindex(b"\x18\x02")
    patched = None
    for m in re.finditer(b"\x18\x02", raw):  # field 3 (model type) of the trainer's part, BPE
        trial = raw[: m.start()] + b"\x18\x01" + raw[m.end() :]
        sp = sentencepiece.SentencePieceProcessor(model_proto=trial)
        if sp.encode("the of and") != sentencepiece.SentencePieceProcessor(model_proto=raw).encode("the of and"):
            patched = sp
            break
    del at
    if patched is None:
        pytest.skip("the table's model type was not found")
    codec = table.codec()
    for text in ("the quick brown fox", "and there it was", "hello world of pieces", "interoperability"):
        ids = patched.nbest_encode_as_ids(text, 2)[0]
        assert sum(table.scores[i] for i in ids) == sum(table.scores[i] for i in codec.encode(text))


def test_pieces_odd_and_empty(spark, odd, none, table):
    rows = pieces.encoded(odd, table, keep=("doc_id", "text")).collect()
    assert len(rows) == len(ODD) and all(r["exact"] for r in rows)
    assert all(r["n_pieces"] == len(r["ids"]) for r in rows)
    back = pieces.decoded(spark.createDataFrame([(r["text"], r["ids"]) for r in rows] + [("", None)], "t string, ids array<int>"), table, keep=("t",)).collect()
    assert all(r["text"] == (r["t"] or "") for r in back[:-1]) and back[-1]["text"] is None
    assert pieces.encoded(none, table).count() == 0

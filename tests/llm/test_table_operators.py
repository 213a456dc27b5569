"""Near duplicates, fingerprints, urls, sites, shards and mixes: against brute force, on odd input and with hot keys."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from porelith.llm import bagminhash, common, fingerprint, mixing, sharding, site_quality, url_filter
from porelith.llm.textblocks import blocks
from porelith.plans import ranks
from porelith.plans.staging import staged

from .conftest import ODD, prose


def one(texts):
    (found,) = [b for _, _, b in blocks(pa.array(texts, pa.string()), 2**40)]
    return found


# -- near duplicates
def multiset(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def brute_classes(rows):
    """Class of each (id, text): least id over links of 0.8 and more."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    named = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return Counter((k, named[find(i)]) for i, (k, _) in enumerate(rows))


def edited(text, n, r):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_signatures_are_unbiased():
    r = random.Random(4)
    left, right = [], []
    for k in range(80):
        t = prose(k, 150) + " " + " ".join(["again and again we go"] * (k % 9))
        left.append(t)
        right.append(edited(t, k % 25, r))
    s = [bagminhash.signatures(*bagminhash.multisets(b), b.n) for b in (one(left), one(right))]
    true = np.array([jaccard(multiset(a), multiset(b)) for a, b in zip(left, right, strict=True)])
    got = (s[0] == s[1]).mean(1)
    assert abs((got - true).mean()) < 0.012
    np.testing.assert_allclose(bagminhash.likeness(one(left), one(right)), true)


def test_signature_does_not_depend_on_the_block():
    texts = [prose(k, 5 + 40 * k) for k in range(6)]
    whole = bagminhash.signatures(*bagminhash.multisets(one(texts)), 6)
    for k, t in enumerate(texts):
        np.testing.assert_array_equal(bagminhash.signatures(*bagminhash.multisets(one([t])), 1)[0], whole[k])


def test_classes_match_brute_force(spark):
    r = random.Random(8)
    rows = []
    for k in range(25):
        t = prose(k, 60 + 3 * k)
        rows += [t, t] + [edited(t, n, r) for n in (0, 1, 2, 3, 6)]
    template = prose(99, 120)
    rows += [template + " " + prose(1000 + k, 45) for k in range(40)]  # alike at about 0.6: no links
    rows += [edited(template, 4, r) for _ in range(30)]  # alike at about 0.7, through the template above it
    rows.append(template)
    rows = list(enumerate(rows))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((x["doc_id"], x["class_id"]) for x in bagminhash.classes(docs).collect())
    assert got == brute_classes(rows)


def test_links_across_classes_of_one_bucket_are_found(spark):
    """With one band a row, all texts share buckets; the rare-window join must find what pivots miss."""
    r = random.Random(5)
    base = prose(1, 100)
    rows = [(k, edited(base, 12, r)) for k in range(12)]
    rows += [(100 + k, edited(t, 1, r)) for k, t in rows]
    texts = spark.createDataFrame(rows, "nid bigint, _text string")
    left = texts.select("nid", F.col("nid").alias("label"))
    pairs = {tuple(sorted((x["a"], x["b"]))) for x in bagminhash._by_rare_windows(left, texts, 0.8).collect()}
    want = {tuple(sorted((a, b))) for a, s in rows for b, t in rows if a < b and jaccard(multiset(s), multiset(t)) >= 0.8}
    assert want and want <= pairs


@pytest.mark.parametrize(("threshold", "rows"), [(0.8, 5), (0.5, 2), (0.95, 12), (0.05, 1)])
def test_bands_follow_the_threshold(threshold, rows):
    assert bagminhash.banding(threshold) == rows


def test_lower_thresholds_link_more(spark):
    r = random.Random(3)
    rows = []
    for k in range(12):
        t = prose(k, 90)
        rows += [t, edited(t, 5, r)]  # alike at about 0.6
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert bagminhash.classes(docs).select("class_id").distinct().count() == 24
    assert bagminhash.classes(docs, threshold=0.5).select("class_id").distinct().count() == 12


def test_frequent_rare_windows_are_split(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "SPLIT", 3)
    test_links_across_classes_of_one_bucket_are_found(spark)


def test_classes_odd_and_empty(spark, odd, none):
    got = Counter((x["doc_id"], x["class_id"]) for x in bagminhash.classes(odd).collect())
    assert got == brute_classes([(i, t) for i, t, _, _ in ODD])
    assert bagminhash.classes(none).count() == 0


def test_near_duplicate_stage(spark, odd, none):
    kept = bagminhash.stage(spark, odd, None)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 1 and 2 are copies; id 2 also has a text of its own, whose class it names; 3, 4, 5 are blank and one class
    assert ids == Counter({1: 1, 2: 1, 3: 1, None: 2, **{k: 1 for k in range(6, 12)}})
    assert bagminhash.stage(spark, none, None).count() == 0
    clash = odd.withColumns({"_at": F.lit("keep"), "__at": F.lit(1), "a.b": F.lit(2), "class_id": F.lit("c")})
    both = bagminhash.stage(spark, clash, None)
    assert both.columns == clash.columns and both.where("_at = 'keep' and __at = 1 and class_id = 'c'").count() == sum(ids.values())


def test_hot_group_of_near_copies(spark):
    r = random.Random(2)
    base = prose(7, 80)
    rows = [(k, edited(base, 1, r)) for k in range(300)] + [(1000 + k, base) for k in range(300)] + [(2000 + k, prose(50 + k, 60)) for k in range(100)]
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x["class_id"] for x in got if x["doc_id"] < 2000} == {0}
    assert all(x["class_id"] == x["doc_id"] for x in got if x["doc_id"] >= 2000)


# -- fingerprints
def brute_sketch(text):
    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]

    def chain(ws):  # Spark hashes an array's elements one after the other
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return signed(h)

    hashes = [chain(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chain(words)] if words else []
    kept = sorted({h for h in hashes if h < -(2**63) + 2**64 // fingerprint.SCALE})
    return (min(hashes) if hashes else None), kept


def brute_shown(s):
    return "" if s[0] is None else f"{s[0] & (2**64 - 1):016X}:" + "".join(f"{h & (2**64 - 1):016X}" for h in s[1])


def brute_containment(a, b):
    return len(set(a[1]) & set(b[1])) / len(a[1]) if a[1] else float(a[0] == b[0])


def brute_fingerprints(rows):
    """Rows with distinct ids, in order of id."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0]))
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_shown(a), brute_shown(b), brute_containment(a, b), brute_containment(a, c)))
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints_match_brute_force(spark):
    rows = [(3 * k, prose(k, 3 + 17 * k)) for k in range(30)] + [(1, None), (2, ""), (4, "été 漢字 \U0001f600 four"), (5, " \t "), (None, prose(77, 40)), (-(2**63), prose(78, 30)), (100, prose(5, 88)), (101, prose(5, 88))]
    random.Random(1).shuffle(rows)
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(brute_fingerprints(rows), key=key)


def test_fingerprints_odd_empty_and_single(spark, odd, none):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[(r["doc_id"], r["n_chars"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert by[(1, len(ODD[0][1]))] == by[(2, len(ODD[0][1]))]
    assert fingerprint.fingerprints(none).count() == 0
    r = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert r["near_next"] == 1


def test_sketches_merge(spark):
    a, b = prose(1, 300), prose(2, 300)
    docs = spark.createDataFrame([("g", a), ("g", b), ("h", a + " " + b)], "k string, text string").withColumn("sketch", fingerprint.sketch(F.col("text")))
    rows = fingerprint.merged(docs, "k").collect()
    g, h = ({r["hash"] for r in rows if r["k"] == k} for k in "gh")
    assert g == set(brute_sketch(a)[1]) | set(brute_sketch(b)[1]) and len(g - h) == 0


# -- urls
def page(link="", refresh=""):
    return f"<html><head><!-- <link rel=canonical href='http://wrong.example/'> --><title>t</title>{link}{refresh}</head><body><link rel=canonical href='http://body.example/'></body></html>"


def canonical(href):
    return page(f'<LINK href="{href}" rel="canonical">')


PAGES = [
    (1, "http://a.example.com/en/1", page()),  # blocked by com/en/
    (2, "http://mirror.org/1", canonical("http://a.example.com/en/1")),  # alias of 1
    (3, "http://far.org/x", page('<link rel="alternate" href="http://n.net/">', "<meta http-equiv='Refresh' content='0; URL=http://mirror.org/1'>")),  # alias of 2
    (4, "http://ok.example.com/en/7/a", canonical("http://b.example.com/en/9")),  # allowed by the longer rule
    (5, "http://b.example.com/en/9", page()),  # own rule: block
    (6, "http://third.org/p", canonical("http://b.example.com/en/9")),  # with 4 and 5: allow goes first
    (7, "HTTP://Sub.NET/de/1?x=1#top", page()),
    (8, "http://notnet/de/", page()),
    (9, None, canonical("http://a.example.com/en/1")),
    (10, "no scheme", None),
    (11, "http://rel.org/dir/page?q=1", canonical("../x")),
    (12, "http://rel.org/dir/page#frag", page(f'<link rel="canonical" href="/en/2">')),
    (13, "http://com/en/", page()),
    (14, "http://far.org/x#again", ""),
    (15, "ftp://x.org/es/a", page()),
]


def brute_judged(rows, links):
    """Verdicts by hand: parts, longest rule, components over ``links``."""
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]

    def rule(u):
        h, p = parts(u)
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
        return max(fits)[1:] if fits else (None, None)

    def node(u):
        return None if u is None or "://" not in u else u.split("#")[0]

    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    out = []
    for k, u, _ in rows:
        r, v = rule(u)
        if v is None:
            acts = {rule(x)[1] for x in group.get(node(u), ())}
            v = "allow" if "allow" in acts else "block" if "block" in acts else "allow"
        out.append((k, *parts(u), r, v))
    return out


LINKS = [
    ("http://mirror.org/1", "http://a.example.com/en/1"), ("http://far.org/x", "http://mirror.org/1"), ("http://ok.example.com/en/7/a", "http://b.example.com/en/9"),
    ("http://third.org/p", "http://b.example.com/en/9"), ("http://rel.org/dir/page?q=1", "http://rel.org/dir/../x"), ("http://rel.org/dir/page", "http://rel.org/en/2"),
]


def test_urls_match_brute_force(spark):
    got = url_filter.judged(spark.createDataFrame(PAGES, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted(brute_judged(PAGES, LINKS))
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts[2] == verdicts[3] == verdicts[14] == "block" and verdicts[6] == verdicts[4] == "allow"


def test_urls_spread_over_many_pages_and_salts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)
    rows = PAGES + [(1000 + k, "http://mirror.org/1", "") for k in range(200)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert got.where("page_id >= 1000 and verdict = 'block'").count() == 200 and got.count() == len(rows)


def test_urls_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, host string, verdict int")
    assert url_filter.judged(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, "h", 1), (1, "", "", None, None), (1, "", "", None, None)], empty.schema)
    assert url_filter.judged(odd).where("verdict = 'allow' and host = '' and path = '' and rule is null").count() == 3


def test_long_chains_are_one_component(spark):
    rows = [(k, f"http://c{k}.org/", canonical(f"http://c{k + 1}.org/")) for k in range(40)] + [(99, "http://c40.org/", canonical("http://z.com/en/"))]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert got.where("verdict = 'block'").count() == 41


def test_urls_follow_the_rules_of_the_contract(spark, tmp_path):
    """Verdicts written out by hand, of the query and of its SQL."""
    import duckdb

    from porelith.llm import queries

    wanted = [
        ("http://com/en/1", "com/en/", "block"), ("http://a.com/en/7", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://www.example.com/en/70", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"),
        ("http://net/de/1", "net/de/", "allow"), ("http://a.net/de/8", "net/de/", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"), ("http://www.example.net/de/80", "example.net/de/8", "block"), ("http://example.net/de/7", "net/de/", "allow"),
        ("http://org/es/", "org/es/", "block"), ("http://a.org/es/7", "org/es/", "block"), ("http://a.net/en/1", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u, page()) for k, (u, _, _) in enumerate(wanted)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op6_url_filter(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got) == [(k, r, v) for k, (_, r, v) in enumerate(wanted)]
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        rows = con.sql(f"SELECT page_id, rule, verdict FROM ({queries.oracle_sql()['op6_url_filter']}) ORDER BY page_id").fetchall()
    assert rows == [(k, r, v) for k, (_, r, v) in enumerate(wanted)]


# -- sites
def test_site_quality(spark, odd, none, labels):
    r = random.Random(3)
    rows, marks = [], []
    for k in range(900):
        site = f"s{k % 6}"
        good = r.random() < (0.95 if k % 6 else 0.2)
        rows.append((k, prose(k, 60) if good else "### $$$ " * 20 + prose(k, 10), site, f"{site}/{k % 2}"))
        marks.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    got = site_quality.rated(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"), F.col("host"), F.col("path")).collect()
    assert len(got) == 900
    truth = dict(marks)
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in got if r["held_out"]]) > 0.97
    host = {rows[r["doc_id"]][2]: r["host_posterior"] for r in got}
    assert host["s0"] < 0.5 < min(v for k, v in host.items() if k != "s0")
    rated = site_quality.rated(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(rated) == len(ODD) and all(0 <= r["score"] <= 1 for r in rated)
    assert site_quality.rated(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert {r["doc_score"] for r in site_quality.rated(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()} == {0.5}


def brute_rated(rows, marks):
    """(doc_score, host and path posterior, score) by id, by loops over rows (id, text, host, path) with labels."""
    crc = lambda k: zlib.crc32(str(k).encode()) % 3
    y = {k: v for k, v in marks.items() if crc(k) != 1}

    def features(text):
        words = text.split()
        letters = [c for c in text if not c.isspace()]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip()]
        n, c = max(len(words), 1), max(len(letters), 1)
        share = lambda f: sum(map(f, letters)) / c
        signs = share(lambda x: x.isascii() and not x.isalnum())
        return [np.log1p(len(words)), share("#*$%&|<>".__contains__), len(covered) / n, (len(lines) - len(set(lines))) / max(len(lines), 1), share(str.isupper), share(str.isdigit), signs, min(len(letters) / n, 20)]

    x = {k: features(t) for k, t, _, _ in rows}
    model = common.Logit().fit(np.array([x[k] for k, *_ in rows if k in y]), np.array([y[k] for k, *_ in rows if k in y]))
    p = {k: float(model.predict(np.array([v]))[0]) for k, v in x.items()}
    e = {k: float(y.get(k, p[k])) for k in p}
    hosts, paths = defaultdict(list), defaultdict(list)
    for k, _, h, q in rows:
        hosts[h].append(e[k])
        paths[h, q].append(e[k])
    p0 = min(0.999, max(0.001, sum(e.values()) / len(e)))

    def strength(groups):  # (values, parent's mean)
        d = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in groups)
        v = sum(m * (1 - m) for _, m in groups)
        w = sum(m * (1 - m) * (len(g) - 1) for g, m in groups)
        rho = (d - v) / w
        return float(np.clip(1 / rho - 1, 1, 10_000)) if rho > 0 else 10_000.0

    sh = strength([(g, p0) for g in hosts.values()])
    host = {h: (sum(g) + sh * p0) / (len(g) + sh) for h, g in hosts.items()}
    sp = strength([(g, host[h]) for (h, _), g in paths.items()])
    odds = lambda v: np.log(v / (1 - v))
    out = {}
    for k, _, h, q in rows:
        g = paths[h, q]
        rest = (sum(g) - e[k] + sp * host[h]) / (len(g) - 1 + sp)
        z = odds(min(max(p[k], 1e-6), 1 - 1e-6)) + 0.5 * (odds(rest) - odds(p0))
        out[k] = (p[k], host[h], (sum(g) + sp * host[h]) / (len(g) + sp), 1 / (1 + np.exp(-z)))
    return out


def test_site_quality_matches_brute_force(spark):
    r = random.Random(11)
    rows, marks = [], {}
    for k in range(400):
        h = f"h{min(int(r.expovariate(0.6)), 6)}"
        good = r.random() < 0.2 + 0.12 * int(h[1])
        noise = " ".join(r.choice(["###", "Aa1", "again and again and", "x\nx"]) for _ in range(r.randrange(9) + 12 * (not good)))
        rows.append((k, prose(k, r.randrange(1, 70)) + " " + noise, h, r.choice("ab")))
        if k % 4:
            marks[k] = int(good)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    got = site_quality.rated(docs, spark.createDataFrame(list(marks.items()), "doc_id bigint, quality int"), F.col("host"), F.col("path")).collect()
    want = brute_rated(rows, marks)
    assert len(got) == 400
    for x in got:
        assert (x["doc_score"], x["host_posterior"], x["path_posterior"], x["score"]) == pytest.approx(want[x["doc_id"]], rel=1e-6)
        assert x["kept"] == (x["score"] >= site_quality.THRESHOLD)


def test_the_site_decides_where_texts_are_alike(spark):
    """The same text everywhere: what the documents' own evidence cannot tell, hosts and paths do, also for documents without a label."""
    truth = {"good": 0.9, "bad": 0.1}
    r = random.Random(1)
    rows = [(k, prose(5, 60), h, f"{h}/{k % 2}") for k, h in enumerate(["good", "bad"] * 400)]
    marks = [(k, int(r.random() < truth[h])) for k, _, h, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    got = site_quality.rated(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"), F.col("host"), F.col("path")).where("held_out").collect()
    assert len({round(x["doc_score"], 9) for x in got}) == 1
    host = {k: h for k, _, h, _ in rows}
    assert all(x["kept"] == (host[x["doc_id"]] == "good") for x in got)


def test_sparse_sites_lean_on_their_parents(spark):
    rows = [(k, prose(k, 60), "big", "big/a") for k in range(300)] + [(1000, prose(1, 60), "big", "big/rare"), (1001, prose(2, 60), "rare", "rare/x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    marks = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(300)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in site_quality.rated(docs, marks, F.col("host"), F.col("path")).collect()}
    assert abs(got[1000]["path_posterior"] - got[1000]["host_posterior"]) < 0.2


# -- shards
def brute_shards(rows, shards=16):
    """(id, size, crc) with shard and slot by ranks on the driver."""
    null_first = lambda k: (k is not None, k or 0)
    by, seen = defaultdict(list), Counter()
    for k, t, s in rows:
        body, source = (t or "").encode(), "n" if s is None else "s" + s
        row = f"{'' if k is None else k}|{source}|{hashlib.md5(body).hexdigest()}"
        digest = hashlib.md5(f"{sharding.SEED}|{row}|{seen[row]}".encode()).hexdigest()
        seen[row] += 1
        u, v = (int(digest[a : a + 13], 16) / 2**52 for a in (0, 13))
        by[source].append((u, null_first(k), len(body) + 1, zlib.crc32(body), v, k))
    placed = []
    for s, xs in by.items():
        xs.sort()
        placed += [((i + x[4]) / len(xs), s, *x) for i, x in enumerate(xs)]
    placed.sort()
    n, out = len(placed), []
    for p, row in enumerate(placed):
        shard = p * shards // n
        out.append((row[-1], row[4], row[5], shard, p - (shard * n + shards - 1) // shards))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 500])
def test_shards_match_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(ranks, "PER_BUCKET", 32)
    r = random.Random(n)
    rows = [(k, prose(k, r.randrange(1, 20)), r.choice(["a", "a", "a", "b", None])) for k in range(n)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert Counter((r["_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == brute_shards(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(16)) <= 1
    assert all({r["slot"] for r in got if r["shard"] == k} == set(range(m)) for k, m in sizes.items())
    for source, total in Counter(s for _, _, s in rows).items():
        ids = {k for k, _, s in rows if s == source}
        per = Counter(r["shard"] for r in got if r["_id"] in ids)
        assert all(abs(per.get(k, 0) - total / 16) <= 3 for k in range(16))


def test_small_sources_are_strewn(spark):
    rows = [(k, f"t{k}", "big") for k in range(8000)] + [(8000 + k, f"t{k}", f"s{k}") for k in range(8000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    per = Counter(r["shard"] for r in got.where("_id < 8000").select("shard").collect())
    assert all(440 <= per[k] <= 560 for k in range(16))
    assert Counter(r["shard"] for r in got.select("shard").collect()) == {k: 1000 for k in range(16)}


@pytest.mark.parametrize("text", ["t{}", "same"])
def test_one_id_on_all_rows_makes_no_hot_bucket(spark, text):
    docs = spark.createDataFrame([(7, text.format(k), "a") for k in range(6000)], "doc_id bigint, text string, source string")
    body = docs.withColumn("_row", sharding.row_key("doc_id", "text", "source"))
    numbered = ranks.numbered_alike(staged(body, "b"), "_row", "n")
    buckets = [r["count"] for r in numbered.groupBy(F.floor(ranks.unit_hash(F.lit("x"), "_row", "n") * 12)).count().collect()]
    assert len(buckets) == 12 and max(buckets) < 600
    got = sharding.sharded(docs).collect()
    assert Counter(r["shard"] for r in got) == {k: 375 for k in range(16)} and len({(r["shard"], r["slot"]) for r in got}) == 6000
    assert mixing.repeated(docs).count() == 6000


def test_shards_odd_and_empty(spark, odd, none, tmp_path):
    got = sharding.sharded(odd).collect()
    assert Counter((r["_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == brute_shards([(i, t, s) for i, t, _, s in ODD])
    assert sharding.sharded(none).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert [r["text"] for r in sorted(back.collect(), key=key)] == [r["text"] for r in sorted(odd.collect(), key=key)]
    clash = odd.withColumns({"_file": F.lit("mine"), "__key": F.lit(5), "slot": F.lit("x")})
    sharding.write_shards(clash, str(tmp_path / "clash"), 4)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert back.where("_file = 'mine' and __key = 5").count() == len(ODD) and back.schema["slot"].dataType.simpleString() == "bigint"


# -- mixes
def brute_targets(sizes):
    """Share by weight, cap, reshare, until none is above; sizes by source in order."""
    w = {s: 1 + i % 3 for i, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: sizes[s] for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[t] for t in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above or len(above) == len(rest):
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PER_BUCKET", 64)
    r = random.Random(6)
    rows = []
    for k in range(1500):
        s = r.choices(["a", "b", "c", "d", None], [50, 20, 20, 2, 8])[0]
        rows.append((k, " ".join(["w"] * int(r.lognormvariate(3, 1))), s))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s))}
    want = brute_targets(order)
    taken = Counter()
    for x in got:
        s = None if x["_source"] == "n" else x["_source"][1:]
        assert x["target"] == pytest.approx(want[s]) and x["source_size"] == sizes[s]
        assert 0 <= x["copies"] <= 3
        taken[s] += x["copies"] * x["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 40
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((x["_id"], x["copies"]) for x in got) == Counter((x["_id"], x["copies"]) for x in again)
    assert mixing.repeated(docs).count() == sum(x["copies"] for x in got)


def test_mix_odd_and_empty(spark, odd, none):
    got = mixing.mixed(odd).collect()
    assert Counter((r["_id"], r["size"]) for r in got) == Counter((i, len((t or "").split(None)) if t else 0) for i, t, _, _ in ODD)
    out = mixing.stage(spark, odd, None)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(none).count() == 0 and mixing.stage(spark, none, None).count() == 0
    clash = odd.withColumns({"__copy": F.lit("mine"), "__copies": F.lit("too"), "__key": F.lit(1.5), "_row": F.lit("r"), "a.b": F.lit(2)})
    both = mixing.stage(spark, clash, None)
    assert both.columns == clash.columns and both.where("__copy = 'mine' and __copies = 'too' and __key = 1.5 and _row = 'r' and `a.b` = 2").count() == out.count()


def test_targets_match_water_filling(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PER_RANGE", 10)
    r = random.Random(9)
    for n in (1, 2, 7, 60):
        names = sorted(f"s{r.randrange(10**6)}é" for _ in range(n - 1)) + [None]
        sizes = {s: r.choice([0, 1, 5, 100, 10_000]) for s in names}
        rows = [("n" if s is None else "s" + s, s, z) for s, z in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "_source string, _name string, source_size bigint"))
        want = brute_targets(sizes)
        assert {x["_source"]: x["target"] for x in got.collect()} == pytest.approx({k: want[s] for k, s, _ in rows})


def test_source_without_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "x y z", "b")], "doc_id bigint, text string, source string")
    got = {r["_id"]: r for r in mixing.mixed(docs).collect()}
    assert got[1]["target"] == 0 and got[1]["copies"] == 0 and got[3]["target"] == 3 and got[3]["copies"] == 1


def test_attached_pairs_rows_alike(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None)], "doc_id bigint, v string")
    found = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 8)], "k bigint, v int")
    got = common.attached(docs, found, {"k": F.col("doc_id")}, ["v"]).collect()
    assert Counter((r["doc_id"], r["v"]) for r in got) == Counter([(1, 5), (1, 6), (2, 7), (None, 8)])


def test_attached_counts_left_out_rows(spark):
    """Two rows alike of which one is left out: the other stays once."""
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id bigint, t string")
    found = spark.createDataFrame([(1, 1), (1, 0), (2, 2)], "k bigint, n int")
    got = common.attached(docs, found, {"k": F.col("doc_id")}, ["n"], "n > 0").collect()
    assert Counter((r["doc_id"], r["n"]) for r in got) == Counter([(1, 1), (2, 2)])

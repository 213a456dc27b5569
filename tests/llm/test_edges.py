"""Texts longer than a block in every operator, and odd input in every stage."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from porelith.llm import bagminhash, fingerprint, language_id, mixing, pieces, quality_rules, sharding, site_quality, toxicity
from porelith.llm.textblocks import BLOCK_BYTES
from porelith.plans.names import unused

from .conftest import ODD, prose
from .test_table_operators import brute_fingerprints, edited
from .test_text_operators import brute_counts, brute_features, one, toxic_corpus


@pytest.fixture(scope="module")
def long(spark):
    import random

    body = prose(1, 320_000) + "\nnitwitty trash can\n" + prose(2, 10)
    rows = [(1, body), (2, edited(body, 5_000, random.Random(1))), (3, body), (4, prose(3, 60)), (5, "short"), (6, None), (7, prose(4, 9)), (8, edited(body, 100_000, random.Random(2)))]
    assert len(body) > BLOCK_BYTES
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)


def test_toxicity_of_long_texts(long):
    lexicon = toxicity.learn(*toxic_corpus(400))
    want = lexicon.curve.predict(np.array([brute_features(lexicon, t) for _, t in long[0]]))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(long[1], lexicon).collect()}
    np.testing.assert_allclose([got[k] for k, _ in long[0]], want, rtol=1e-9)


def test_language_of_long_texts(long):
    trees = language_id.ByteTrees({"a": [b"alpha beta gamma delta"], "b": [b"der hund und die katze"]})
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(long[1], trees).collect()}
    assert got[1] == got[3] == got[2] == ("a", 1.0) and got[6] == ("und", 0.0)
    assert got[4] == (trees.predict(one([long[0][3][1]]))[0][0], pytest.approx(trees.predict(one([long[0][3][1]]))[1][0]))


def test_counts_of_long_texts(long):
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.counted(long[1]).collect()}
    assert got == {k: brute_counts(t) for k, t in long[0]}


def test_fingerprints_of_long_texts(long):
    got = sorted(tuple(r) for r in fingerprint.fingerprints(long[1]).collect())
    assert got == sorted(brute_fingerprints(long[0]))


def test_classes_of_long_texts(long):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(long[1]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_pieces_of_long_texts(long):
    table = pieces.PieceTable.load(pieces.default_model())
    got = {r["doc_id"]: r["ids"] for r in pieces.encoded(long[1], table).collect()}
    assert all(table.codec().decode(got[k]) == (t or "") for k, t in long[0])
    assert got[1] == table.codec().encode(long[0][0][1])


def test_sites_shards_and_mixes_of_long_texts(spark, long):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in site_quality.rated(long[1], labels, F.lit("h"), F.lit("p")).collect()}
    assert len(got) == 8 and got[1] == pytest.approx(got[3], rel=0.2)
    docs = long[1].withColumn("source", F.lit("s"))
    sizes = {r["_id"]: (r["size"], r["text_crc32"]) for r in sharding.sharded(docs).collect()}
    assert sizes == {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in long[0]}
    assert {r["_id"]: r["size"] for r in mixing.mixed(docs).collect()} == {k: len((t or "").split()) for k, t in long[0]}


@pytest.mark.parametrize("name", ["toxicity", "quality_rules", "pieces"])
def test_stages_on_odd_and_empty_tables(spark, odd, none, labels, tmp_path, name):
    """Nulls in any column, repeated rows and clashing names; the other two stages have their tests beside their operators."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clash = odd.withColumns({"k0": F.lit("mine"), "_text": F.lit(1), "ids0": F.lit(2.5), "a.b": F.lit(3)})
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, clash, str(tmp_path))
    rows = got.collect()
    if name == "pieces":
        codec = pieces.PieceTable.load(pieces.default_model()).codec()
        assert Counter((r["doc_id"], codec.decode(r["ids"])) for r in rows) == Counter((k, t or "") for k, t, _, _ in ODD)
        assert all(r["exact"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    else:
        assert got.columns == clash.columns and all(r["k0"] == "mine" and r["_text"] == 1 and r["a.b"] == 3 for r in rows)
        counts = [(k, brute_counts(t)) for k, t, _, _ in ODD]
        fit = Counter(k for k, c in counts if c[0] >= 50 and 2 * c[4] <= c[0])
        if name == "quality_rules":
            assert Counter(r["doc_id"] for r in rows) == fit
        else:
            lexicon = toxicity.train(toxicity.training_rows(clash), labels)
            scores = lexicon.curve.predict(np.array([brute_features(lexicon, t) for _, t, _, _ in ODD]))
            assert Counter(r["doc_id"] for r in rows) == Counter(k for (k, *_), s in zip(ODD, scores, strict=True) if s < 0.7)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "x int, X_ int")
    assert unused(df, "y") == "y" and unused(df, "x") == "x__"

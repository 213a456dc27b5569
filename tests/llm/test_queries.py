"""The registered queries on the smallest tables: against SQL where there is any, and by their contracts."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from porelith.llm import queries
from tests.test_queries import SF, duck, plain, same  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    same(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_quality_rules_equal_sql_where_cutoffs_bite(spark, tmp_path):
    r = random.Random(2)
    docs, marks = [], []
    for k in range(4000):
        lang = ("aa", "bb", None)[k % 3] if k % 50 else "dd"
        good = r.random() < 0.8
        words = [f"w{r.randrange(500)}" for _ in range(r.randrange(48, 70))]
        if not good:
            words[: len(words) // 3] = r.choice([["#$"], ["same", "old", "line\n"]]) * 6
        docs.append((k % 3950, " ".join(words), lang))
        marks.append((k, int(good)))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op3_quality_rules(spark, str(tmp_path))
    assert got.where("not base_failed and not kept").count() > 50
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cols = sorted(got.columns)
    assert plain(map(tuple, got.select(*cols).collect())) == plain(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()['op3_quality_rules']})").fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize(("name", "modulo", "value"), [("op1_toxicity", 3, 1), ("op2_language_id", 5, 0)])
def test_held_out_rows(spark, docs, name, modulo, value):
    rows = queries.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulo == value) and 0 <= r["score"] <= 1 for r in rows)


def test_language_held_out_accuracy(spark, docs):
    got = queries.op2_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_fingerprints_tell_neighbours_apart(spark):
    rows = queries.op4_fingerprint(spark, SF).where("n_chars > 2000").collect()
    assert np.mean([r["near_edited"] for r in rows]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in rows])
    assert abs(np.mean([r["near_edited"] for r in rows]) - 0.75) < 0.06


def test_exact_copies_share_a_class(spark, docs):
    got = queries.op5_bagminhash(spark, SF).join(docs.select("doc_id", "text"), "doc_id")
    assert got.groupBy("text").agg(F.count_distinct("class_id").alias("n")).where("n > 1").count() == 0
    assert got.where("class_id > doc_id").count() == 0


def test_pieces_are_exact(spark):
    assert queries.op7_pieces(spark, SF).where("not exact or n_pieces != size(ids)").count() == 0


def test_shards_are_even(spark):
    sizes = [r["count"] for r in queries.op9_sharding(spark, SF).groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 16

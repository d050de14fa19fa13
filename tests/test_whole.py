"""The whole job of feed queries where an earlier version did part of it."""

import itertools

from compare import connect, same
from pyspark.sql import functions as F

from plazafeed.operators import dedupe as D
from plazafeed.plans import registry

SF = "/root/testdata/sf0.001"


def grouped(ids, pairs):
    root = {i: i for i in ids}
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_near_dup_docs_is_brute_force(spark, tmp_path):
    """The given texts, and copies of some with another language tag or another first word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id % 5 = 0")
    copies = some.withColumns({"doc_id": F.col("doc_id") + 100_000, "lang": F.lit("zz")}).union(some.withColumns({"doc_id": F.col("doc_id") + 200_000, "text": F.concat(F.lit("Changed "), "text")}))
    docs.union(copies).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.group_id for r in registry.queries()["near_dup_docs"](spark, str(tmp_path)).collect()}
    x = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.col("text").alias("summary"), F.lit("").alias("venue_title"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("event_has_explicit_time"), F.lit("2014-01-01").cast("timestamp").alias("event_date"))
    rows = list(D.with_signatures(x, "UTC").toPandas().itertuples())
    want = grouped([r.id for r in rows], [(a.id, b.id) for a, b in itertools.combinations(rows, 2) if D._same(a, b)])
    assert got == want and sum(got[100_000 + i] == got[i] for i in got if i + 100_000 in got) > 30


def test_preview_keys_take_the_whole_title(spark, tmp_path):
    spark.createDataFrame([(k, "word " * 30 + str(k), "en", "s", 151) for k in range(2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.preview_key for r in registry.queries()["preview_keys"](spark, str(tmp_path)).collect()}) == 2


def orders_query(spark, name, sf="/root/testdata/sf0.01"):
    return same(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])


def test_reminder_texts_of_every_order(spark):
    assert orders_query(spark, "reminder_texts") == 15_000


def test_every_round(spark):
    assert orders_query(spark, "round_robin") == 15_000


def test_tied_drafts_stay(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_custkey").distinct().count()
    assert orders_query(spark, "draft_states") == n


def test_ties_of_drafts_have_one_result(spark):
    from plazafeed.streaming.jobs import draft_states

    for rows in ([(1, "published", 5), (1, "rejected", 9)], [(1, "rejected", 9), (1, "published", 5)]):
        log = spark.createDataFrame(rows, "draft_id long, status string, id long").withColumn("at", F.lit("1997-01-01").cast("timestamp"))
        assert draft_states(log, "1998-01-01 00:00:00", tie="id").first().status == "rejected"

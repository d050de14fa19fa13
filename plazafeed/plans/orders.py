"""Queries on TPC-H-like tables that stand in for dated items, drafts, catalogs and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import dedupe as D
from ..operators import filters as P
from ..operators import joins as J
from ..operators import ranking as R
from .registry import query, table

AS_OF = "1998-01-01 00:00:00"


def dated(spark, d):
    """``orders`` as dated items."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("summary"), F.lit(False).alias("event_has_explicit_time"))


@query("allowed_window", """SELECT o_orderkey AS id, o_orderdate AS event_date FROM orders
 WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-01'""")
def allowed_window(spark, d):
    return P.in_allowed_window(dated(spark, d), AS_OF, "1998-01-01 00:00:00", "1998-03-01 00:00:00").select("id", "event_date")


@query("within_days", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31'")
def within_days(spark, d):
    return P.within_days(dated(spark, d), F.col("event_date"), 30, AS_OF).select("id")


@query("horizon_counts", """SELECT count(*) FILTER (o_orderdate >= t) AS upcoming,
 count(*) FILTER (o_orderdate BETWEEN t AND t + INTERVAL 7 DAY) AS next_7, count(*) FILTER (o_orderdate BETWEEN t AND t + INTERVAL 30 DAY) AS next_30,
 count(*) FILTER (o_orderdate BETWEEN t AND t + INTERVAL 120 DAY) AS next_120, count(DISTINCT o_orderpriority) FILTER (o_orderdate >= t) AS kinds,
 count(DISTINCT o_custkey) FILTER (o_orderdate >= t) AS visuals,
 count(*) FILTER (o_orderdate >= t) >= 10 AND count(*) FILTER (o_orderdate BETWEEN t AND t + INTERVAL 30 DAY) >= 10
 AND count(DISTINCT o_custkey) FILTER (o_orderdate >= t) >= 10 AS ready FROM orders, (SELECT TIMESTAMP '1998-01-01' AS t)""")
def horizon_counts(spark, d):
    return A.readiness(dated(spark, d), AS_OF, visual="custkey")


@query("delivery_stats", """SELECT count(*) AS created, count(*) FILTER (o_orderstatus = 'O') AS pending,
 count(*) FILTER (o_orderstatus = 'F') AS delivered, count(*) FILTER (o_orderstatus = 'P') AS failed
 FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-15'""")
def delivery_stats(spark, d):
    o = dated(spark, d)
    at = lambda s: F.when(F.col("status") == s, F.col("event_date"))
    drafts = o.select(F.col("event_date").alias("created_at"), F.when(F.col("status") == "O", "pending").otherwise(F.col("status")).alias("status"), at("F").alias("manager_delivered_at"), at("P").alias("manager_delivery_failed_at"), F.lit(None).cast("string").alias("manager_delivery_error"))
    return A.delivery_stats(drafts, "1995-06-15").select("created", "pending", "delivered", "failed")


@query("status_counts", "SELECT coalesce(nullif(o_orderstatus, ''), 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return A.status_counts(dated(spark, d))


@query("cooldown_anti", """SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN
 (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 60 DAY)""")
def cooldown_anti(spark, d):
    o = dated(spark, d).withColumn("item_id", F.col("custkey").cast("string"))
    posted = o.where(F.col("event_date") < AS_OF).select(F.col("id").alias("draft_id"), "item_id", F.col("event_date").alias("posted_at"))
    return J.cooldown(o.where(F.col("event_date") >= AS_OF).select("id", "item_id"), posted, AS_OF, 60).select("id")


@query("reminders", """SELECT o_custkey AS user_id, o_orderkey AS target_id, name AS "offset", o_orderdate - to_hours(h) AS due_at
 FROM orders, (VALUES ('24h', 24), ('1h', 1)) v(name, h)
 WHERE o_orderdate - to_hours(h) > TIMESTAMP '1998-01-01' AND NOT (o_orderstatus = 'P' AND name = '24h')""")
def reminders(spark, d):
    asked = dated(spark, d).select(F.col("custkey").alias("user_id"), F.col("id").alias("target_id"), "event_date", F.col("status").alias("s"))
    twins = asked.where("s = 'P'").select("user_id", "target_id", F.lit("24h").alias("offset"), F.lit("pending").alias("status"))
    return J.create_reminders(asked.drop("s"), twins, AS_OF).select("user_id", "target_id", "offset", "due_at")


@query("round_robin", """SELECT o_orderkey AS id, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_orderpriority
 ORDER BY o_orderdate, o_orderkey) AS round FROM orders""")
def round_robin(spark, d):
    return R.interleave(dated(spark, d), "kind", ["event_date", "id"]).select("id", "kind", "round")


@query("digest", """SELECT o_orderkey AS id, o_totalprice AS score, 'Order ' || o_orderkey || ' — ' || strftime(o_orderdate, '%d.%m %H:%M') AS line
 FROM orders ORDER BY score DESC, id LIMIT 12""")
def digest(spark, d):
    return R.digest(dated(spark, d)).select("id", "score", "line")


@query("event_feed", """SELECT o_orderkey AS id, o_orderdate AS event_date, o_totalprice AS priority_score,
 CAST(1 + o_custkey % 4 AS INTEGER) AS source_count FROM orders
 WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-01' AND (1 + o_custkey % 4 > 1 OR o_totalprice >= 80)
 ORDER BY source_count DESC, event_date, priority_score DESC, 'Order ' || o_orderkey, id LIMIT 600""")
def event_feed(spark, d):
    items = dated(spark, d).withColumn("categories", F.array(F.lit("events"))).withColumn("source_count", (1 + F.col("custkey") % 4).cast("int")).withColumn("priority_score", F.col("score")).withColumn("type", F.lit("html"))
    return R.feed(items, AS_OF, "1998-01-01 00:00:00", "1998-06-01 00:00:00", ["expected"])[0].select("id", "event_date", "priority_score", "source_count")


@query("feed_total", """SELECT count(*) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-01' AND (1
 + o_custkey % 4 > 1 OR o_totalprice >= 80)""")
def feed_total(spark, d):
    items = dated(spark, d).withColumn("categories", F.array(F.lit("events"))).withColumn("source_count", (1 + F.col("custkey") % 4).cast("int")).withColumn("priority_score", F.col("score")).withColumn("type", F.lit("html"))
    return R.feed(items, AS_OF, "1998-01-01 00:00:00", "1998-06-01 00:00:00", ["expected"])[1]


@query("stale_customers", """SELECT c_custkey AS section_id, max(o_orderdate) AS last_run,
 max(o_orderdate) IS NULL OR max(o_orderdate) + INTERVAL 90 DAY < TIMESTAMP '1998-01-01' AS stale FROM customer LEFT
 JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def stale_customers(spark, d):
    reg = table(spark, d, "customer").select(F.col("c_custkey").alias("section_id"), F.lit(90).alias("refresh_days"))
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("section_id"), F.col("o_orderdate").alias("generated_at"))
    return A.stale_sections(reg, runs, AS_OF).select("section_id", "last_run", "stale")


@query("dedupe_best", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_extendedprice DESC, l_linenumber) = 1""")
def dedupe_best(spark, d):
    return D.dedupe_best(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")])


@query("merge_best", """SELECT o_custkey AS custkey, min(o_orderkey) AS id, max(o_totalprice) AS score, min(o_orderdate) AS event_date,
 list_sort(list(DISTINCT o_orderpriority)) AS categories, count(*) AS group_size,
 CAST(greatest(len(list(DISTINCT o_orderstatus)), 1) AS INTEGER) AS source_count, max(o_totalprice) + 6 * (greatest(len(list(DISTINCT o_orderstatus)),
 1) - 1) AS priority_score FROM orders GROUP BY 1""")
def merge_best(spark, d):
    none = lambda c: F.lit(None).cast("string").alias(c)
    items = dated(spark, d).select("id", "custkey", "title", "summary", "event_date", "event_has_explicit_time", "score", F.col("score").alias("base_score"), "kind", none("venue_title"), none("image_url"), none("url"), F.array("kind").alias("categories"), F.array("status").alias("source_ids"), F.array("status").alias("source_names"), F.col("event_date").alias("seen_at"), F.col("event_date").alias("updated_at"))
    return D.merge_group(items, "custkey").select("custkey", "id", "score", "event_date", "categories", "group_size", "source_count", "priority_score")


@query("snapshot_merge", """WITH a AS (SELECT o_orderkey AS id, 'u' || o_orderkey AS url, o_totalprice AS score, 0 AS n FROM orders
 WHERE o_orderdate < TIMESTAMP '1997-01-01'
 UNION ALL SELECT o_orderkey, 'u' || o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
 SELECT id, arg_max(score, n) AS score, CASE WHEN min(n) = 1 THEN 'new' WHEN max(n) = 1 THEN 'updated' ELSE 'retained' END AS merge_state FROM a
 GROUP BY id, url""")
def snapshot_merge(spark, d):
    o = dated(spark, d).withColumn("url", F.concat(F.lit("u"), F.col("id").cast("string"))).withColumn("venue_title", F.lit(""))
    cols = ["id", "url", "title", "venue_title", "event_date", "score", "summary"]
    prev = o.where("event_date < timestamp'1997-01-01'").select(*cols)
    nxt = o.where("event_date >= timestamp'1996-01-01'").withColumn("score", F.col("score") + 1).select(*cols)
    return D.merge_snapshots(prev, nxt, "UTC").select("id", "score", "merge_state")


@query("upsert_items", """SELECT o_orderkey AS id, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN o_totalprice + 1
 ELSE o_totalprice END AS score,
 CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN o_orderdate ELSE TIMESTAMP '1998-01-01' END AS seen_at, CASE
 WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN TIMESTAMP '1998-01-01' ELSE o_orderdate END AS updated_at FROM orders""")
def upsert_items(spark, d):
    o = dated(spark, d).select("id", "score", "event_date")
    old = o.where("event_date < timestamp'1997-01-01'").select("id", "score", F.col("event_date").alias("seen_at"), F.col("event_date").alias("updated_at"))
    return D.upsert(old, o.where("event_date >= timestamp'1996-01-01'").select("id", (F.col("score") + 1).alias("score")), AS_OF)


@query("chunks", """SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_suppkey
 ORDER BY l_orderkey, l_linenumber) - 1) // 10 AS INTEGER) AS chunk, CASE WHEN (row_number() OVER (PARTITION BY l_suppkey
 ORDER BY l_orderkey, l_linenumber) - 1) // 10 = 0 THEN 'replace' ELSE 'merge' END AS mode FROM lineitem""")
def chunks(spark, d):
    return R.assign_chunks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), 10, "l_suppkey", ["l_orderkey", "l_linenumber"]).drop("l_suppkey")


@query("quota_topn", """WITH r AS (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type
 ORDER BY p_retailprice DESC, p_partkey) AS k FROM part)
 SELECT p_partkey, p_type, CASE WHEN k = 1 THEN 1 WHEN k <= 3 THEN 2 ELSE 3 END AS phase FROM r
 ORDER BY phase, p_retailprice DESC, p_partkey LIMIT 200""")
def quota_topn(spark, d):
    return R.quota_topn(table(spark, d, "part"), "p_type", "p_retailprice", 3, 200, "p_partkey").select("p_partkey", "p_type", "phase")


@query("personalized_topn", """WITH w AS (SELECT l_suppkey, p_type, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey
 GROUP BY ALL)
 SELECT l_suppkey, p_type, weight, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, p_type) AS rn FROM w QUALIFY rn <= 3""")
def personalized_topn(spark, d):
    from pyspark.sql import Window

    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum("l_quantity").alias("weight"))
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("weight"), "p_type"))).where("rn <= 3")


@query("unposted", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem
 WHERE l_returnflag = 'R' AND l_quantity > 40)
 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-09-01')""")
def unposted(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.unposted(table(spark, d, "orders").select("o_orderkey"), li.where("l_returnflag = 'R' and l_quantity > 40"), li.where("l_shipdate >= timestamp'1998-09-01'"), "o_orderkey")


_BATCH_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'concert' WHEN '2-HIGH' THEN 'sport' WHEN '3-MEDIUM' THEN 'theatre' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'quiz' END"


@query("select_batch", f"""WITH RECURSIVE
 posted AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
 c AS (SELECT o_orderkey AS id, {_BATCH_KIND} AS kind, o_totalprice AS score, last, ['c' || o.o_custkey, 'v' || o.o_custkey % 37,
 'd' || o_orderdate || '|' || o_orderkey % 3] AS marks
  FROM orders o LEFT JOIN posted USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1998-01-01'
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'P' AND o_totalprice > 400000)),
 t(tier, days) AS (VALUES (0, 900), (1, 200), (2, 7), (3, 0)), p(n, wanted) AS (VALUES (1, 'concert'), (2, 'sport'), (3, 'theatre'), (4, NULL)),
 q(kind, quota) AS (VALUES ('concert', 8), ('sport', 7), ('theatre', 7), ('other', 7), ('quiz', 7)),
 f AS (SELECT c.*, quota, TIMESTAMP '1998-01-01' AS now FROM c JOIN q USING (kind)),
 s AS (SELECT 0 AS step, 0 AS tier, 1 AS n, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS marks, CAST([] AS VARCHAR[]) AS kinds,
 CAST([] AS INTEGER[]) AS tiers, CAST([] AS INTEGER[]) AS phases
  UNION ALL SELECT step + 1, CASE WHEN n = 5 AND best.id IS NULL THEN tier + 1 ELSE tier END,
   CASE WHEN n <= 3 THEN n + 1 WHEN best.id IS NOT NULL THEN n WHEN n = 4 THEN 5 ELSE 1 END,
   CASE WHEN best.id IS NULL THEN taken ELSE list_append(taken, best.id) END, CASE
 WHEN best.id IS NULL THEN marks ELSE list_concat(marks, best.marks) END, CASE WHEN best.id IS NULL THEN kinds ELSE list_append(kinds, best.kind) END,
   CASE WHEN best.id IS NULL THEN tiers ELSE list_append(tiers, tier) END, CASE
 WHEN best.id IS NULL THEN phases ELSE list_append(phases, greatest(n - 2, 1)) END
  FROM (SELECT s.step, s.tier, s.n, s.taken, s.marks, s.kinds, s.tiers, s.phases, arg_min({{'id': f.id, 'marks': f.marks, 'kind': f.kind}},
 {{'a': -f.score, 'b': f.id}}) AS best
   FROM s JOIN t USING (tier) LEFT JOIN p ON p.n = s.n LEFT JOIN f ON (f.last IS NULL OR t.days = 0 OR f.last <= f.now - to_days(t.days))
 AND NOT list_has_any(f.marks, s.marks) AND NOT list_contains(s.taken, f.id)
    AND (s.n > 3 OR (f.kind = p.wanted AND NOT list_contains(s.kinds, f.kind))) AND (s.n <> 4 OR len(list_filter(s.kinds,
 lambda x: x = f.kind)) < f.quota)
   WHERE len(s.taken) < 20 GROUP BY ALL)),
 l AS (SELECT * FROM s ORDER BY step DESC LIMIT 1)
 SELECT unnest(taken) AS id, unnest(tiers) AS tier, unnest(phases) AS phase, CAST(unnest(range(1, len(taken) + 1)) AS INTEGER) AS pos FROM l""")
def select_batch(spark, d):
    """A batch of 20 of the coming orders: one a customer, a visual, and a day and title; customers served lately wait."""
    o = dated(spark, d).withColumn("item_id", F.col("custkey").cast("string"))
    kinds = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), ("concert", "sport", "theatre", "quiz")))
    kind = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in kinds.items()))
    image = F.concat(F.lit("https://img.test/"), (F.col("custkey") % 37).cast("string"), F.lit(".jpg"))
    cands = o.where(F.col("event_date") >= AS_OF).withColumns({"kind": kind, "image_url": image, "venue_title": F.lit(""), "title_key": F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), "date_key": F.date_format("event_date", "yyyy-MM-dd HH:mm")})
    past = o.where(F.col("event_date") < AS_OF).select(F.col("id").alias("draft_id"), "item_id", F.col("event_date").alias("posted_at"), "status", "score")
    return R.select_batch(cands, past, past.where("status = 'P' and score > 400000").select("draft_id", "item_id"), 20, AS_OF, (900, 200, 7, 0), "score").select("id", "tier", "phase", "pos")


@query("catalog_merge", """SELECT coalesce(c_custkey, k) AS key, coalesce(name, c_name) AS name, coalesce(bal, c_acctbal) AS bal,
 c_custkey IS NULL AS appended
 FROM customer FULL JOIN (SELECT 2 * s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT -s_suppkey, s_name, s_acctbal
 FROM supplier) ON c_custkey = k""")
def catalog_merge(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    imported = s.select((2 * F.col("k")).alias("key"), "name", "bal").unionByName(s.select((-F.col("k")).alias("key"), "name", "bal"))
    return J.merge_catalog(base, imported, ["key"])


@query("catalog_search", """SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand),
 '[^\\p{L}\\p{N}]+', ' ', 'g'), 'widget')""")
def catalog_search(spark, d):
    return P.search(table(spark, d, "part"), " WIDGET ", ["p_name", "p_type", "p_brand"]).select("p_partkey")


@query("ticket_links", """SELECT p_partkey, r_name AS platform, 'https://' || lower(replace(r_name, ' ',
 '')) || '.example.net/search?q=' || replace(replace(replace(replace(replace(url_encode(name), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'),
 '%2A', '*') AS link
 FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' «Ёлка» & C°' WHEN 1 THEN p_name || '!*''()?=/#%+' ELSE p_name END AS name
 FROM part) CROSS JOIN region""")
def ticket_links(spark, d):
    i = F.col("p_partkey") % 3
    more = F.when(i == 0, " «Ёлка» & C°").when(i == 1, "!*'()?=/#%+").otherwise("")
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", more).alias("title"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("https://"), F.lower(F.replace("r_name", F.lit(" "), F.lit(""))), F.lit(".example.net/search?q={query}")).alias("search_url"))
    return J.ticket_links(p, r).select("p_partkey", F.explode("ticket_links").alias("t")).select("p_partkey", F.col("t.name").alias("platform"), F.col("t.url").alias("link"))


@query("coverage_rollup", """WITH f AS (SELECT s_nationkey, s_suppkey, count(*) FILTER (l_quantity > 25) AS photos FROM supplier
 JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL)
 SELECT s_nationkey AS section_id, grouping(s_nationkey) AS total, count(*) AS items, count(*) FILTER (photos > 0) AS ok,
 count(*) FILTER (photos = 0) AS empty, count(*) FILTER (photos IS NULL) AS missing
 FROM supplier LEFT JOIN f USING (s_nationkey, s_suppkey) GROUP BY ROLLUP (s_nationkey)""")
def coverage_rollup(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("section_id"), F.col("s_suppkey").alias("item_id"))
    files = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("item_id")).select("section_id", "item_id", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("bytes"))
    return A.coverage(s, files)


@query("fallback_join", """WITH a AS (SELECT c_custkey AS k, min(c_name) AS v FROM customer WHERE c_custkey % 3 = 0
 GROUP BY 1), b AS (SELECT c_nationkey AS n, min(c_name) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
 SELECT o_orderkey AS id, coalesce(a.v, b.v) AS name, CASE WHEN a.v IS NOT NULL THEN 'key' WHEN b.v IS NOT NULL THEN 'fallback' END AS found_by
 FROM orders LEFT JOIN a ON o_custkey = a.k LEFT JOIN b ON o_custkey % 25 = b.n""")
def fallback_join(spark, d):
    t = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_name").alias("name"))
    items = dated(spark, d).select("id", "custkey", (F.col("custkey") % 25).cast("long").alias("nation"))
    return J.lookup_with_fallback(items, t, ["custkey"], ["nation"], "name").select("id", "name", "found_by")


@query("reconcile_uploads", """SELECT l_orderkey, l_linenumber, max(CASE
 WHEN l_returnflag = 'R' THEN l_shipdate END) OVER (PARTITION BY l_partkey) AS uploaded_at,
 max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) OVER (PARTITION BY l_partkey) IS NULL AND l_returnflag = 'N' AS pending_upload
 FROM lineitem""")
def reconcile_uploads(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("url"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("uploaded_at"), (F.col("l_returnflag") == "N").alias("pending_upload"))
    return J.reconcile_uploads(li).drop("url")


@query("source_stats", """WITH a AS (SELECT l_suppkey AS source_id, count(*) AS collected, 'old' AS state FROM lineitem
 WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT l_suppkey AS source_id, count(*) AS collected, 'new' AS state FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
 SELECT coalesce(b.source_id, a.source_id) AS source_id, coalesce(b.collected, a.collected) AS collected, coalesce(b.state, a.state) AS state FROM a
 FULL JOIN b USING (source_id)""")
def source_stats(spark, d):
    li = table(spark, d, "lineitem")
    one = lambda c, s: li.where(c).groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count("*").alias("collected")).withColumn("state", F.lit(s))
    return A.merge_source_stats(one("l_shipdate < timestamp'1996-01-01'", "old"), one("l_shipdate >= timestamp'1998-06-01'", "new"))


@query("draft_states", """WITH l AS (SELECT o_custkey AS draft_id, CASE o_orderstatus WHEN 'F' THEN 'published'
 WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status, o_orderdate AS t, o_orderkey AS k FROM orders),
 g AS (SELECT draft_id, min(t) AS created_at, max(t) AS updated_at FROM l GROUP BY 1), s AS (SELECT draft_id, status FROM l
 QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY t DESC, k DESC) = 1)
 SELECT draft_id, CASE WHEN status = 'pending' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 HOUR THEN 'expired' ELSE status END AS status,
 created_at, updated_at FROM g JOIN s USING (draft_id)""")
def draft_states(spark, d):
    """Every draft; of equal times the event with the larger order id counts."""
    from ..streaming.jobs import draft_states as fold

    log = dated(spark, d).select(F.col("custkey").alias("draft_id"), F.when(F.col("status") == "F", "published").when(F.col("status") == "P", "rejected").otherwise("pending").alias("status"), F.col("event_date").alias("at"), "id")
    return fold(log, AS_OF, tie="id")


@query("reminder_texts", """SELECT o_orderkey AS id, 'Напоминание: Order ' || o_orderkey || ' — завтра, ' || strftime(timezone('Europe/Moscow',
 timezone('UTC', o_orderdate)), '%d.%m %H:%M') AS text FROM orders""")
def reminder_texts(spark, d):
    from ..functions.copy import reminder_text

    return dated(spark, d).select("id", reminder_text(F.col("title"), F.lit("24h"), F.col("event_date"), "Europe/Moscow").alias("text"))

"""Queries that write files from a table and read them back, and queries of page extraction and text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators.staging import shared_folder
from ..sources import pages as S
from ..sources import readers, sinks, udtf
from ..streaming import jobs
from .registry import query, table
from .texts import TITLE_SQL, docs

SOURCE = {"id": "s1", "name": "Export", "categories": "events,news"}
PLAIN_SQL = f"trim(regexp_replace({TITLE_SQL}, '[^A-Za-z0-9]+', ' ', 'g'), ' ')"


def plain_title():
    return F.trim(F.regexp_replace("title", "[^A-Za-z0-9]+", " "))


def written_lists(df, name, as_object=False):
    """``df`` as JSON files of up to 200 rows each: a bare array, or an object with ``items``."""
    path = shared_folder(df.sparkSession, name)
    rows = df.groupBy(F.floor(F.col("doc_id") / 200).alias("part")).agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("items"))
    body = F.to_json(F.struct("items")) if as_object else F.to_json("items")
    rows.select("part", body.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return path


@query("social_export", f"""SELECT 'https://s/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id
 WHEN {PLAIN_SQL} = '' THEN 'Export' ELSE {PLAIN_SQL} END AS title, 'social' AS type, 's1' AS source_id, 'events,news' AS categories
 FROM documents""")
def social_export(spark, d):
    """Captions of documents written as exports; every third has a title of its own."""
    i = F.col("doc_id").cast("string")
    caption = F.when(plain_title() == "", " \n ").otherwise(F.concat(F.lit("\n  "), plain_title(), F.lit(" \nmore")))
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title "), i))
    items = docs(spark, d).select("doc_id", i.alias("id"), own.alias("title"), caption.alias("caption"), F.concat(F.lit("https://s/"), i).alias("url"), F.lit("2026-01-01").alias("published_at"))
    got = readers.read_social_export(spark, written_lists(items, "export"), SOURCE)
    return got.select("url", "title", "type", "source_id", F.array_join("categories", ",").alias("categories"))


@query("feed_items", f"""SELECT 'https://f/' || doc_id AS url, trim('T ' || {PLAIN_SQL}, ' ') AS title,
 trim('text & ' || doc_id || ' ' || {PLAIN_SQL}, ' ') AS summary, CASE WHEN doc_id % 2 = 0 THEN '2026-01-02' ELSE 'Thu, 01 Jan' END AS published_at
 FROM documents""")
def feed_items(spark, d):
    """Documents written as RSS items, their summaries as markup, and read as a feed."""
    i = F.col("doc_id")
    coded = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), coded(c), F.lit(f"</{name}>"))
    body = F.concat(F.lit("<p>text &amp; "), i.cast("string"), F.lit("</p> <i>"), plain_title(), F.lit("</i>"))
    parts = [
        element("title", F.concat(F.lit("T "), plain_title())), element("link", F.concat(F.lit("https://f/"), i.cast("string"))), F.when(i % 3 > 0, element("description", body)).otherwise(element("content:encoded", body)),
        element("pubDate", F.lit("Thu, 01 Jan")), F.when(i % 2 == 0, element("isoDate", F.lit("2026-01-02"))).otherwise(""),
    ]
    path = shared_folder(spark, "feed")
    items = docs(spark, d).select(F.floor(i / 200).alias("part"), F.concat(F.lit("<item>"), *parts, F.lit("</item>")).alias("item"))
    feeds = items.groupBy("part").agg(F.array_join(F.collect_list("item"), "").alias("items"))  # of 200 items each
    whole = F.concat(F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>no</title>'), F.col("items"), F.lit("</channel></rss>"))
    feeds.select("part", whole.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return readers.read_feed(spark, path, SOURCE).select("url", "title", "summary", "published_at")


@query("snapshot_items", f"""SELECT 'https://n/' || doc_id AS url, {PLAIN_SQL} AS title, CAST(n_chars AS DOUBLE) AS score FROM documents UNION ALL
 SELECT 'https://b/' || doc_id, {PLAIN_SQL}, 1.0 FROM documents WHERE doc_id % 2 = 0""")
def snapshot_items(spark, d):
    """Snapshots as objects with items and as bare arrays; one that is not there is passed over."""
    t = table(spark, d, "documents").select("doc_id", "n_chars").join(docs(spark, d).select("doc_id", plain_title().alias("title")), "doc_id")
    one = lambda df, to, score: df.select("doc_id", "title", F.concat(F.lit(to), F.col("doc_id").cast("string")).alias("url"), score.cast("double").alias("score"))
    paths = [written_lists(one(t, "https://n/", F.col("n_chars")), "snapshot", True), written_lists(one(t.where("doc_id % 2 = 0"), "https://b/", F.lit(1.0)), "snapshot")]
    return readers.read_snapshots(spark, [*paths, paths[0] + "-none"], "title string, url string, score double").drop("file")


def _ld_pages(spark, d):
    """Pages with a JSON-LD graph put behind their markup, and on every fourth a broken block before it."""
    i = F.col("page_id").cast("string")
    event = F.concat(F.lit('{"@graph": [{"@type": "MusicEvent", "name": "Page '), i, F.lit('", "startDate": "2026-05-'), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"), F.lit('", "location": {"name": "Hall '), (F.col("page_id") % 7).cast("string"), F.lit('"}, "image": ["https://i/'), i, F.lit('.jpg", "x"]}, {"@type": "Place", "name": "no"}]}'))
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    broken = F.when(F.col("page_id") % 4 == 0, block(F.lit('{"@type": "Event", "name": '))).otherwise("")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://p/"), i).alias("url"), F.concat(F.coalesce("html", F.lit("")), broken, block(event)).alias("html"))


_LD_SQL = "SELECT 'https://p/' || page_id AS url, 'Page ' || page_id AS title, '2026-05-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS start_date, 'Hall ' || page_id % 7 AS venue, 'https://i/' || page_id || '.jpg' AS image FROM pages"


@query("page_events_sql", _LD_SQL)
def page_events_sql(spark, d):
    """The table function beside each page."""
    udtf.register(spark)
    _ld_pages(spark, d).createOrReplaceTempView("ld_pages")
    return spark.sql("SELECT e.* FROM ld_pages, LATERAL page_events(html, ld_pages.url) e")


@query("page_candidates", f"SELECT url, title, venue AS venues, start_date AS start_dates, image FROM ({_LD_SQL})")
def page_candidates(spark, d):
    """What the page's own markup does not have comes from its JSON-LD."""
    c = S.extract_page_candidates(_ld_pages(spark, d))
    return c.select("url", F.get("titles", 0).alias("title"), F.array_join("venues", ",").alias("venues"), F.array_join("start_dates", ",").alias("start_dates"), F.get("images", 0).alias("image"))


_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789")


@query("search_texts", f"""SELECT doc_id, sha256(trim(regexp_replace(translate(lower(coalesce(text, '')), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ',
 'g'), ' ')) AS text_sha256 FROM documents WHERE nfc_normalize(coalesce(text, '')) = coalesce(text, '')""")
def search_texts(spark, d):
    """Whole texts, of every second one the small letters and digits in their wide forms."""
    return _search(docs(spark, d))


def _search(t):
    wide = F.translate("text", "abcdefghijklmnopqrstuvwxyz0123456789", _WIDE)
    found = text.search_text(F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.coalesce("text", F.lit(""))))
    return t.select("doc_id", F.sha2(F.coalesce(found, F.lit("")), 256).alias("text_sha256"))


_HITS_SQL = "len(regexp_extract_all({}, '[РС][\\x{{80}}-¿Ѐ-Џѐ-џ°±²³µ¶·]|[ÃÐÑ][\\x{{80}}-¿]'))"
_LOW, _HIGH = text._BYTES, text._CP1251


@query("repair_texts", f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes
 FROM documents),
 g AS (SELECT doc_id, text, list_contains(bytes, '98') AS lost, translate(array_to_string(list_transform(bytes,
 lambda x: chr(CAST('0x' || x AS INTEGER))), ''), '{_LOW}', '{_HIGH}') AS bad FROM b),
 h AS (SELECT *, {_HITS_SQL.format("bad")} AS n, {_HITS_SQL.format("text")} AS m FROM g)
 SELECT doc_id, sha256(CASE WHEN NOT lost AND (n >= 3 OR n > 0.04 * length(bad)) AND m < n THEN text ELSE bad END) AS text_sha256 FROM h""")
def repair_texts(spark, d):
    """Whole texts, garbled by reading their bytes in the wrong code page, and repaired."""
    bad = F.translate(F.decode(F.coalesce("text", F.lit("")).cast("binary"), "ISO-8859-1"), _LOW, _HIGH)
    return docs(spark, d).withColumn("bad", bad).select("doc_id", F.sha2(text.repair_mojibake(F.col("bad")), 256).alias("text_sha256"))


@query("event_log", "SELECT event_id, event_type FROM events ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id DESC LIMIT 700")
def event_log(spark, d):
    """Events appended in four batches, one of them twice, days beyond the cap retired: the newest 700."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    log = sinks.EventLog(spark, shared_folder(spark, "log"), 700, "event_id")
    for k in (0, 1, 1, 2, 3):
        log.append(e.where(F.col("event_id") % 4 == k), k)
    log.retire()
    return log.newest().select("event_id", "event_type")


@query("listing_ingest", f"""SELECT url, CASE WHEN n % 8 = 0 THEN title || ' again' ELSE title END AS title, venue
 FROM (SELECT *, CAST(substr(url, 11) AS BIGINT) AS n FROM ({_LD_SQL}))""")
def listing_ingest(spark, d):
    """Pages landed in four loads and ingested, every eighth landed again with another name and ingested in a second run: micro-batches, extracted, published by batch; the latest of each url."""
    landed, out = shared_folder(spark, "landed"), shared_folder(spark, "listings")
    pages = _ld_pages(spark, d)
    for k in range(4):
        pages.where(F.col("page_id") % 4 == k).select("url", "html").write.mode("append").parquet(landed)
    again = F.regexp_replace("html", r'"name": "(Page \d+)"', '"name": "$1 again"')
    state = shared_folder(spark, "listings-state")

    def extract(batch):
        c = S.extract_page_candidates(batch)
        return c.select("url", F.get("titles", 0).alias("title"), F.get("venues", 0).alias("venue"))

    def ingest():
        stream = jobs.read_landed(spark, landed, "url string, html string", files_per_trigger=64)
        jobs.ingest_listings(stream, extract, jobs.publish_batches(out), state).awaitTermination()

    ingest()
    pages.where("page_id % 8 = 0").select("url", again.alias("html")).write.mode("append").parquet(landed)
    ingest()
    return jobs.latest_rows(spark, out, "url")

"""Readers of exports, feeds, snapshots, registries and inventories."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

SOCIAL = "id string, title string, caption string, url string, published_at string"
FEED = "title string, link string, description string, `content:encoded` string, pubDate string, isoDate string, guid string"


def raw_item(source: dict[str, str], kind: str, title: Column, summary: Column, url: Column, published: Column) -> list[Column]:
    fixed = lambda k: F.lit(source.get(k, "")).alias(f"source_{k}")
    return [fixed("id"), fixed("name"), F.lit(kind).alias("type"), title.alias("title"), summary.alias("summary"), url.alias("url"), published.alias("published_at"), F.array(*[F.lit(c) for c in source.get("categories", "").split(",") if c]).cast("array<string>").alias("categories")]


def read_social_export(spark: SparkSession, path: str, source: dict[str, str]) -> DataFrame:
    """Items of a JSON export; the title is the first filled line of the caption where none is given, else the source's name."""
    df = spark.read.schema(SOCIAL).json(path, multiLine=True)
    line = F.get(F.filter(F.transform(F.split(F.coalesce("caption", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    return df.select(*raw_item(source, "social", text.first_truthy(F.col("title"), line, F.lit(source.get("name", ""))), F.col("caption"), F.col("url"), F.col("published_at")))


def read_feed(spark: SparkSession, path: str, source: dict[str, str]) -> DataFrame:
    """Items of RSS files; summary from the description, else the content; the ISO date before the other."""
    df = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    summary = text.strip_html(text.first_truthy(F.col("description"), F.col("content:encoded")))
    return df.select(*raw_item(source, "rss", F.col("title"), summary, F.col("link"), text.first_truthy(F.col("isoDate"), F.col("pubDate"))))


def read_snapshots(spark: SparkSession, paths: Sequence[str], item_schema: str) -> DataFrame:
    """Items of snapshot files (an object with ``items``, or a bare array), each with the file it came from; missing files are passed over."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = [p for p in paths if hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]
    if not there:
        return spark.createDataFrame([], item_schema + ", file string")
    raw = spark.read.text(there, wholetext=True, recursiveFileLookup=True).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    rows = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{item_schema.replace(' string', ':string').replace(' double', ':double').replace(' timestamp', ':timestamp').replace(' boolean', ':boolean').replace(' int', ':int')}>>")).otherwise(
        F.from_json("v", f"items array<struct<{item_schema.replace(' string', ':string').replace(' double', ':double').replace(' timestamp', ':timestamp').replace(' boolean', ':boolean').replace(' int', ':int')}>>").getField("items"))
    return raw.select(F.explode(rows).alias("i"), "file").select("i.*", "file")


def load_sources(configured: DataFrame, *directories: DataFrame) -> DataFrame:
    """Configured sources and directory lists, the last definition of an id winning; disabled ones go."""
    tagged = configured.withColumn("_ord", F.lit(0))
    for k, d in enumerate(directories, 1):
        tagged = tagged.unionByName(d.withColumn("_ord", F.lit(k)), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("_ord"))
    return tagged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_ord").where(F.coalesce("enabled", F.lit(True)))


def resolve_city(cities: DataFrame, refs: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``refs(ref)`` with the city whose id, slug, name or alias it is, whatever the case; empty fields from ``defaults``."""
    names = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("id", "slug", "name"), F.coalesce("aliases", F.array().cast("array<string>")))), lambda x: F.lower(F.trim(x))))
    known = cities.withColumn("_name", F.explode(names))
    j = refs.join(known, F.lower(F.trim("ref")) == F.col("_name"), "left").drop("_name")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(dict(j.dtypes)[c])) for c, v in defaults.items() if c in j.columns})


def read_catalog(raw: DataFrame) -> DataFrame:
    """Sections with nested items, as rows ``(section_id, section_title, ord, item fields)``."""
    return raw.select("section_id", F.col("title").alias("section_title"), F.posexplode("items").alias("ord", "i")).select("section_id", "section_title", "ord", "i.*")


def photo_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Photos under ``root/section/item/file`` in natural order, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(root).select("path", F.col("length").alias("bytes"))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    rows = files.select(part(-3).alias("section_id"), part(-2).alias("item_id"), part(-1).alias("file"), "bytes")
    natural = F.array_join(F.transform(F.regexp_extract_all("file", F.lit(r"\d+|\D+"), 0), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("section_id", "item_id").orderBy(natural))).withColumn("label", F.initcap(F.regexp_replace(F.regexp_replace("file", r"\.[^.]+$", ""), r"[-_]+", " ")))


def normalize_image_search(responses: DataFrame, keep: int = 5, max_bytes: int = 20_000_000) -> DataFrame:
    """Images of ``responses(item_id, body)`` (JSON, pages by id): allowed types, 8 kB to ``max_bytes``, once a url, no bad titles, the best few."""
    page = "struct<title:string,imageinfo:array<struct<url:string,mime:string,size:long,width:int,height:int,extmetadata:struct<Artist:struct<value:string>,LicenseShortName:struct<value:string>>>>>"
    pages = F.map_values(F.from_json("body", f"query struct<pages:map<string,{page}>>").getField("query").getField("pages"))
    rows = responses.select("item_id", F.explode(pages).alias("p")).select("item_id", "p.title", F.get("p.imageinfo", 0).alias("i"))
    rows = rows.select("item_id", "title", "i.url", "i.mime", "i.size", "i.width", "i.height", text.strip_html(F.col("i.extmetadata.Artist.value")).alias("artist"), F.col("i.extmetadata.LicenseShortName.value").alias("license"))
    good = rows.where(F.col("mime").isin("image/jpeg", "image/png", "image/webp") & F.col("size").between(8192, max_bytes) & ~F.lower("title").rlike("map|logo|coat of arms|flag|diagram|icon"))
    score = F.least(F.col("width") * F.col("height") / 100000, F.lit(60)) + F.when(F.col("width") > F.col("height"), 20).otherwise(0)
    once = good.withColumn("score", score).withColumn("_rn", F.row_number().over(Window.partitionBy("item_id", "url").orderBy("title"))).where("_rn = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "url"))).where(F.col("rank") <= keep).drop("_rn")


def kind_map(spark: SparkSession, pairs: dict[str, str], source: str = "") -> DataFrame:
    """A mapping table; sources that map a word in their own way bring rows under their name."""
    a = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(v).alias("kind")) for k, v in pairs.items()])
    return spark.range(1).select(F.explode(a).alias("m")).select(F.lit(source).alias("source"), "m.word", "m.kind")


def map_kind(word: Column, pairs: dict[str, str], default: str = "events") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), F.lower(word)), F.lit(default))

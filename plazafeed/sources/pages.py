"""Extraction from landed pages: listings, links, embedded state, meta tags, JSON-LD, tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..functions.time import parse_date


@dataclass(frozen=True)
class ListingRules:
    """Class names of an item's block and of the fields in it."""

    item: str
    title: str
    summary: str = ""
    date: str = ""
    source_id: str = ""
    source_name: str = ""


class _Blocks(HTMLParser):
    """Fields of the blocks of one page; kept small, it runs inside a task."""

    def __init__(self, rules: ListingRules):
        super().__init__()
        self.rules, self.depth, self.rows, self.row, self.into = rules, 0, [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        self.depth += 1
        if self.row is None and self.rules.item in names:
            self.row = {"title": "", "summary": "", "date": "", "link": "", "_depth": self.depth}
        if self.row is not None:
            self.into += [(f, self.depth) for f in ("title", "summary", "date") if getattr(self.rules, f) and getattr(self.rules, f) in names]
            if tag == "a" and not self.row["link"]:
                self.row["link"] = a.get("href") or ""

    def handle_data(self, data):
        if self.row is not None:
            for f, _ in self.into:
                self.row[f] += data

    def handle_endtag(self, tag):
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        self.into = [x for x in self.into if x[1] < self.depth]
        if self.row is not None and self.depth <= self.row["_depth"]:
            self.rows.append(self.row)
            self.row = None
        self.depth -= 1


RAW = "source_id string, source_name string, type string, title string, summary string, url string, published_at string, page_url string"


def extract_listing_items(pages: DataFrame, rules: ListingRules) -> DataFrame:
    """Raw items of listing ``pages(url, html)``: blocks by class name, links resolved; rows with neither title nor summary go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html in zip(b["url"], b["html"]):
                p = _Blocks(rules)
                p.feed(html or "")
                rows += [(rules.source_id, rules.source_name, "html", " ".join(r["title"].split()), " ".join(r["summary"].split()), r["link"], r["date"].strip(), url) for r in p.rows]
            yield pd.DataFrame(rows, columns=["source_id", "source_name", "type", "title", "summary", "url", "published_at", "page_url"])

    out = pages.select("url", "html").mapInPandas(run, RAW)
    return out.withColumn("url", keys.absolute_url(F.col("url"), F.col("page_url"))).where("title <> '' or summary <> ''").drop("page_url")


class _Posts(HTMLParser):
    """Texts of the blocks with a class, whatever stands inside them; br is a line end."""

    def __init__(self, block: str):
        super().__init__()
        self.block, self.depth, self.posts, self.post, self.top = block, 0, [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "br" and self.post is not None:
            self.post.append("\n")
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        self.depth += 1
        if self.post is None and self.block in (dict(attrs).get("class") or "").split():
            self.post, self.top = [], self.depth

    def handle_data(self, data):
        if self.post is not None:
            self.post.append(data.replace("\n", " "))

    def handle_endtag(self, tag):
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        if self.post is not None and self.depth <= self.top:
            self.close_post()
        self.depth -= 1

    def close_post(self) -> None:
        lines = (" ".join(x.split()) for x in "".join(self.post or ()).split("\n"))
        self.posts.append("\n".join(lines).strip("\n"))
        self.post = None


def extract_channel_posts(pages: DataFrame, source_name: str, block: str) -> DataFrame:
    """One row a post of a channel page, by the class of its block: first line as title, else the source's name; empty posts go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html in zip(b["url"], b["html"]):
                p = _Posts(block)
                p.feed(html or "")
                if p.post is not None:
                    p.close_post()
                rows += [(url, k, x) for k, x in enumerate(p.posts) if x]
            yield pd.DataFrame(rows, columns=["url", "pos", "summary"])

    posts = pages.select("url", "html").mapInPandas(run, "url string, pos int, summary string")
    return posts.select("url", "pos", text.first_truthy(F.trim(F.get(F.split("summary", "\n"), 0)), F.lit(source_name)).alias("title"), "summary")


def extract_links(pages: DataFrame, include: str = "", exclude: str = "", limit: int | None = None, page_key: str = "page_id") -> DataFrame:
    """``(page, url, ord)``: absolute links without fragments, first occurrence kept, in page order, at most ``limit`` a page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#][^"']*)["']"""), 1)
    raw = pages.select(page_key, F.col("url").alias("page_url"), F.posexplode(hrefs).alias("pos", "href"))
    raw = raw.withColumn("url", F.regexp_replace(keys.absolute_url(text.decode_entities(F.trim("href")), F.col("page_url")), "#.*$", ""))
    if include:
        raw = raw.where(F.col("url").rlike(include))
    if exclude:
        raw = raw.where(~F.col("url").rlike(exclude))
    first = raw.groupBy(page_key, "url").agg(F.min("pos").alias("pos"))
    out = first.withColumn("ord", F.row_number().over(Window.partitionBy(page_key).orderBy("pos")))
    return (out.where(F.col("ord") <= limit) if limit else out).select(page_key, "url", "ord")


def extract_sitemap_links(maps: DataFrame, sections: Sequence[str], start: str, end: str) -> DataFrame:
    """``(url, section, url_date)`` of ``<loc>`` entries with an allowed section and a trailing date inside the window."""
    loc = maps.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))
    loc = loc.select(keys.canonical_url(text.decode_entities(F.col("url"))).alias("url")).distinct()
    date = F.try_to_date(F.regexp_extract("url", r"(\d{4}-\d{2}-\d{2})/?$", 1))
    section = F.regexp_extract("url", r"^[a-z]+://[^/]+/(?:[^/]+/)*?(" + "|".join(sections) + r")/", 1)
    return loc.withColumn("section", section).withColumn("url_date", date).where((F.col("section") != "") & F.col("url_date").between(start, end))


def _meta(html: Column, name: str) -> Column:
    a = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*?(?:name|property)\s*=\s*["']{name}["'][^>]*?content\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*?content\s*=\s*["']([^"']*)["'][^>]*?(?:name|property)\s*=\s*["']{name}["']""", 1)
    return text.first_truthy(a, b)


def _tag(html: Column, tag: str, entities: Sequence[tuple[str, str]] = text.ENTITIES) -> Column:
    return F.nullif(text.strip_html(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), entities), F.lit(""))


def extract_embedded_json_events(pages: DataFrame, marker: str = "__INITIAL_STATE__", root: str = "$.event") -> DataFrame:
    """Event rows from JSON state in a script: title, description, venue, dates, the first image of several places."""
    raw = F.regexp_extract("html", rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    v = pages.withColumn("_v", F.try_parse_json(F.nullif(raw, F.lit("")))).where("_v is not null")
    flat = lambda c: F.when(~c.rlike(r"^\s*[\[{]"), c)
    at = lambda p: flat(F.try_variant_get("_v", f"{root}.{p}", "string"))
    images = ("image", "poster", "cover", "imageUrl", "media.image", "media[0].url", "images[0]", "images[0].url")
    return v.select("url", at("title").alias("title"), text.first_truthy(at("description"), at("summary")).alias("summary"), text.first_truthy(at("venue.title"), at("place.name")).alias("venue_title"),
                    text.first_truthy(at("startDate"), at("date")).alias("date_text"), text.first_truthy(*map(at, images)).alias("image_url")).where("title is not null")


def extract_meta_events(pages: DataFrame, as_of: datetime | str, tz: str, entities: Sequence[tuple[str, str]] = text.ENTITIES, clean: Callable[[Column], Column] = text.clean_title) -> DataFrame:
    """Event rows from title and meta tags; the date is the first dd.mm.yyyy with its time. ``entities`` are those that title elements use, ``clean`` what a title loses."""
    title = text.first_truthy(_meta(F.col("html"), "og:title"), _tag(F.col("html"), "title", entities))
    body = text.strip_html(F.col("html"))
    d = parse_date(F.regexp_extract(body, r"(\d{1,2}\.\d{1,2}\.\d{4}(?:[^\d]{1,12}\d{1,2}:\d{2})?)", 1), as_of, tz)
    out = pages.select("url", clean(title).alias("title"), text.first_truthy(_meta(F.col("html"), "description"), _meta(F.col("html"), "og:description")).alias("summary"), d.alias("d"), _meta(F.col("html"), "og:image").alias("image_url"))
    return out.select("url", "title", "summary", F.col("d.ts").alias("event_date"), F.col("d.explicit").alias("event_has_explicit_time"), "image_url").where("title is not null")


def extract_page_candidates(pages: DataFrame) -> DataFrame:
    """Arrays of candidate titles, summaries, venues, images and start dates: JSON-LD events (``@graph`` too) before page hints."""
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    lists = pages.withColumn("_ld", F.transform(blocks, lambda x: F.try_parse_json(x)))
    events = F.filter("_ld", lambda v: v.isNotNull() & F.coalesce(F.lower(F.coalesce(F.try_variant_get(v, "$['@type']", "string"), F.try_variant_get(v, "$['@graph'][0]['@type']", "string"))).contains("event"), F.lit(False)))
    def take(*paths: str) -> Column:
        found = lambda v: F.array(*[F.coalesce(F.try_variant_get(v, f"$.{p}", "string"), F.try_variant_get(v, f"$['@graph'][0].{p}", "string")) for p in paths])
        return F.filter(F.flatten(F.transform(events, found)), lambda x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]"))  # a list or an object is told by its parts

    h = F.col("html")
    return lists.select(
        "url", F.array_distinct(F.concat(take("name"), F.array_compact(F.array(_meta(h, "og:title"), _tag(h, "h1"), _tag(h, "title"))))).alias("titles"),
        F.array_distinct(F.concat(take("description"), F.array_compact(F.array(_meta(h, "og:description"), _meta(h, "description"))))).alias("summaries"),
        take("location.name").alias("venues"), F.array_distinct(F.concat(take("image", "image[0]", "image.url"), F.array_compact(F.array(_meta(h, "og:image"))))).alias("images"), take("startDate").alias("start_dates"),
    )


def extract_fixture_rows(pages: DataFrame, home: str, venue: str, as_of: datetime | str, tz: str) -> DataFrame:
    """Sport events from table rows (date, match, venue): a title, a summary by template, 70 points at home and 66 away; undated and past rows go."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("pos", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda x: text.strip_html(x))
    c = rows.withColumn("c", cells).where(F.size("c") >= 2)
    d = parse_date(F.get("c", 0), as_of, tz)
    at_home = F.lower(F.get("c", 1)).startswith(home.lower())
    out = c.select("url", "pos", F.get("c", 1).alias("title"), d.alias("d"), at_home.alias("home"), text.first_truthy(F.get("c", 2), F.when(at_home, F.lit(venue))).alias("venue_title"))
    out = out.select("url", "pos", "title", F.col("d.ts").alias("event_date"), F.col("d.explicit").alias("event_has_explicit_time"), "venue_title", F.when(F.col("home"), 70).otherwise(66).alias("base_score"), F.lit("sport").alias("kind"))
    return out.withColumn("summary", F.format_string("%s. %s", F.col("title"), F.coalesce("venue_title", F.lit("")))).where(F.col("event_date") >= F.lit(str(as_of)).cast("timestamp"))


#: What ends a paragraph: its own end, a block that begins, or the end of what it stands in.
PARAGRAPH = (
    r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</(?:p|article|aside|blockquote|body|details|div|fieldset|figure|footer|form|header|html|li|main|nav|section|td|th)[\s>]"
    r"|<(?:p|address|article|aside|blockquote|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|pre|section|table|ul)[\s>/]|\z)"
)


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted either way or bare."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return text.first_truthy(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def page_snapshots(pages: DataFrame, lengths: Sequence[int | None] = (160, 160, 400)) -> DataFrame:
    """Title, h1, description and image of each page, texts cut to ``lengths`` characters (None: whole); ``ok`` with any of the texts.

    The description is told by meta tags, else it is the first paragraph of an article, of
    ``main``, of the page; the image is told by meta tags, else it is the page's first.
    Scripts, styles and comments are no part of the page.
    """
    page = F.col("html")
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        page = F.regexp_replace(page, pattern, " ")
    h = F.col("_h")
    meta = lambda name: F.regexp_extract(h, rf"""(?is)<meta\s[^>]*?(?:name|property)\s*=\s*["']?{name}["'\s/>][^>]*>?""", 0)
    inside = lambda tag: F.array_join(F.regexp_extract_all(h, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|\z)"), 1), " ")
    first = lambda c: F.nullif(text.strip_html(F.regexp_extract(c, PARAGRAPH, 1)), F.lit(""))
    value = lambda c: F.nullif(F.trim(F.regexp_replace(text.decode_entities(F.col(c)), r"[\s\x{A0}]+", " ")), F.lit(""))
    tags = {f"_{n}": meta(n) for n in ("description", "og:description", "og:image", "twitter:image")} | {"_img": F.regexp_extract(h, r"(?is)<img\s[^>]*>?", 0)}
    rest = [c for c in pages.columns if c != "html"]
    # step by step, so that each text is sought once
    out = pages.withColumn("_h", page).withColumns(tags | {"title": _tag(h, "title"), "h1": _tag(h, "h1"), "_p": F.coalesce(*map(first, (inside("article"), inside("main"), h)))})
    out = out.withColumns({c: _attribute(F.col(f"`{c}`"), "src" if c == "_img" else "content") for c in tags}).withColumns({c: value(f"`{c}`") for c in tags})
    out = out.withColumns({"description": F.coalesce("_description", "`_og:description`", "_p"), "image": F.coalesce("`_og:image`", "`_twitter:image`", "_img")})
    out = out.select(*rest, "title", "h1", "description", keys.absolute_url(F.col("image"), F.col("url")).alias("image"))
    cut = [(F.col(c) if n is None else F.substring(c, 1, n)).alias(c) for c, n in zip(("title", "h1", "description"), lengths, strict=True)]
    return out.select(*rest, *cut, "image", F.coalesce("title", "h1", "description").isNotNull().alias("ok"))


def flag_blocked_pages(pages: DataFrame, pattern: str = r"(?i)captcha|are you a robot|checking your browser|access denied|ddos-guard", family: str = "family", order: str = "ord") -> DataFrame:
    """Pages before their family's first challenge page: that page and what came after it in the run are dropped; ``blocked`` families are named by ``first_block``."""
    f = pages.withColumn("challenge", F.coalesce(F.col("html").rlike(pattern), F.lit(False)))
    first = f.where("challenge").groupBy(family).agg(F.min(order).alias("first_block"))
    return f.join(first, family, "left").where(F.col("first_block").isNull() | (F.col(order) < F.col("first_block"))).drop("challenge")

"""Readers, page extraction and writers."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from plazafeed.sources import pages as S
from plazafeed.sources import readers, sinks

SRC = {"id": "s1", "name": "Источник", "categories": "events"}


def page(spark, html, url="https://a.test/list/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_exports_and_feeds(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"id": "1", "caption": "\n Первая строка\nвторая", "url": "u"}, {"id": "2", "title": "Т"}, {"id": "3"}]))
    assert [r.title for r in readers.read_social_export(spark, str(tmp_path / "x.json"), SRC).orderBy("url").collect()].count("Источник") == 1
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link><description>&lt;p&gt;txt&lt;/p&gt;</description><pubDate>d</pubDate></item></channel></rss>")
    r = readers.read_feed(spark, str(tmp_path / "f.xml"), SRC).first()
    assert (r.title, r.summary, r.url, r.published_at, r.categories) == ("A", "txt", "l", "d", ["events"])
    (tmp_path / "s1.json").write_text(json.dumps({"items": [{"title": "A"}]}))
    (tmp_path / "s2.json").write_text(json.dumps([{"title": "B"}]))
    got = readers.read_snapshots(spark, [str(tmp_path / n) for n in ("s1.json", "s2.json", "none.json")], "title string, url string")
    assert sorted(r.title for r in got.collect()) == ["A", "B"]


def test_registry(spark):
    a = spark.createDataFrame([("1", "A", True), ("2", "B", True)], "id string, name string, enabled boolean")
    b = spark.createDataFrame([("2", "B2", False), ("3", "C", None)], "id string, name string, enabled boolean")
    assert sorted(r.name for r in readers.load_sources(a, b).collect()) == ["A", "C"]
    cities = spark.createDataFrame([("c1", "slug", "Город", ["алиас"], None)], "id string, slug string, name string, aliases array<string>, tz string")
    refs = spark.createDataFrame([("АЛИАС",), ("нет",)], "ref string")
    assert {r.ref: (r.id, r.tz) for r in readers.resolve_city(cities, refs, {"tz": "UTC"}).collect()} == {"АЛИАС": ("c1", "UTC"), "нет": (None, "UTC")}


def test_listing(spark):
    html = '<div class="card"><a href="/e/1"><h3 class="t">Один</h3></a><p class="s">Текст</p></div><div class="card"><img src="x"></div>'
    r = S.extract_listing_items(page(spark, html), S.ListingRules("card", "t", "s")).collect()
    assert [(x.title, x.summary, x.url) for x in r] == [("Один", "Текст", "https://a.test/e/1")]
    posts = '<div class="tgme_widget_message_text js">Первая<br/>вторая</div><div class="tgme_widget_message_text"> </div>'
    assert [(x.title, x.summary) for x in S.extract_channel_posts(page(spark, posts), "К", "tgme_widget_message_text").collect()] == [("Первая", "Первая\nвторая")]


def test_links_and_sitemaps(spark):
    html = '<a href="/a#x">1</a><a href="https://b.test/?q=1&amp;z=2">2</a><a class="c" href="/a">3</a><a href="#top">4</a><a href="/skip">5</a>'
    assert [r.url for r in S.extract_links(page(spark, html), exclude="skip").orderBy("ord").collect()] == ["https://a.test/a", "https://b.test/?q=1&z=2"]
    xml = spark.createDataFrame([("<loc> https://a.test/concert/x-2026-05-01/ </loc><loc>https://a.test/concert/y-2027-05-01</loc><loc>https://a.test/other/z-2026-05-01</loc>",)], "xml string")
    assert [(r.section, str(r.url_date)) for r in S.extract_sitemap_links(xml, ["concert"], "2026-01-01", "2026-12-31").collect()] == [("concert", "2026-05-01")]


def test_details(spark):
    state = '<script>window.__INITIAL_STATE__ = {"event": {"title": "Шоу", "description": "О", "venue": {"title": "Зал"}, "startDate": "2026-05-01", "images": [{"url": "https://i"}]}};</script>'
    r = S.extract_embedded_json_events(page(spark, state)).first()
    assert (r.title, r.venue_title, r.date_text, r.image_url) == ("Шоу", "Зал", "2026-05-01", "https://i")
    meta = '<html><head><title>Матч | Сайт</title><meta name="description" content="Опис"></head><body>01.05.2026, 19:00</body></html>'
    r = S.extract_meta_events(page(spark, meta), "2026-03-10", "Europe/Moscow").first()
    assert (r.title, r.summary, r.event_date) == ("Матч", "Опис", datetime(2026, 5, 1, 16))
    ld = '<script type="application/ld+json">{"@type": "MusicEvent", "name": "LD", "location": {"name": "V"}, "startDate": "2026-05-01", "image": "https://i"}</script><h1>H</h1>'
    r = S.extract_page_candidates(page(spark, ld)).first()
    assert (r.titles, r.venues, r.images, r.start_dates) == (["LD", "H"], ["V"], ["https://i"], ["2026-05-01"])
    rows = "<table><tr><td>01.05.2026 19:00</td><td>Наши — Гости</td><td></td></tr><tr><td>01.01.2020</td><td>x</td><td></td></tr></table>"
    r = S.extract_fixture_rows(page(spark, rows), "Наши", "Арена", "2026-03-10", "Europe/Moscow").collect()
    assert [(x.title, x.venue_title, x.base_score) for x in r] == [("Наши — Гости", "Арена", 70)]
    snap = S.page_snapshots(page(spark, '<title>T</title><h1>H</h1><p>P</p><img src="/i.png">')).first()
    assert (snap.title, snap.h1, snap.description, snap.image, snap.ok) == ("T", "H", "P", "https://a.test/i.png", True)


def test_blocked(spark):
    df = spark.createDataFrame([("f", 1, "ok"), ("f", 2, "Captcha!"), ("f", 3, "ok"), ("g", 1, "ok")], "family string, ord int, html string")
    assert sorted((r.family, r.ord) for r in S.flag_blocked_pages(df).collect()) == [("f", 1), ("g", 1)]


def test_images(spark, tmp_path):
    body = json.dumps({"query": {"pages": {"1": {"title": "File:A.jpg", "imageinfo": [{"url": "u1", "mime": "image/jpeg", "size": 90000, "width": 1200, "height": 800}]}, "2": {"title": "File:Logo.png", "imageinfo": [{"url": "u2", "mime": "image/png", "size": 90000, "width": 10, "height": 10}]}}}})
    assert [r.url for r in readers.normalize_image_search(spark.createDataFrame([("i", body)], "item_id string, body string")).collect()] == ["u1"]
    d = tmp_path / "photos" / "sights" / "tower"
    d.mkdir(parents=True)
    for n in ("10.jpg", "2.jpg", "note.txt"):
        (d / n).write_bytes(b"x")
    assert [(r.section_id, r.item_id, r.file) for r in readers.photo_inventory(spark, str(tmp_path / "photos")).orderBy("ord").collect()] == [("sights", "tower", "2.jpg"), ("sights", "tower", "10.jpg")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "b", 1), ("s", "a", 2)], "section_id string, item_id string, v int")
    assert [i.item_id for i in sinks.section_overrides(df).first()["items"]] == ["a", "b"]
    path = sinks.write_version(df, str(tmp_path / "t"), 3)
    assert spark.read.parquet(path).count() == 2
    log = spark.createDataFrame([(k, datetime(2026, 1, 1 + k)) for k in range(5)], "event_id int, ts timestamp")
    assert sorted(r.event_id for r in sinks.append_events(log, log.limit(0), 2, "event_id").collect()) == [3, 4]
    best = spark.createDataFrame([("k1", "T", "new"), ("k2", "U", "new")], "preview_key string, title string, url string")
    old = spark.createDataFrame([("k1", "old", datetime(2026, 1, 1)), ("k9", "gone", datetime(2026, 1, 1))], "preview_key string, url string, updated_at timestamp")
    assert {r.preview_key: r.url for r in sinks.preview_manifest(best, old, "2026-03-10").collect()} == {"k1": "old", "k2": "new"}
    assert [r.preview_key for r in sinks.stale_previews(best, old).collect()] == ["k9"]
    items = "url string, title string, venue_title string, summary string, event_date timestamp"
    prev = spark.createDataFrame([("u1", "A", "", "x", datetime(2026, 5, 1))], items)
    nxt = spark.createDataFrame([("u2", "B", "", "y", datetime(2026, 6, 1))], items)
    assert sinks.write_snapshot(prev, nxt, "incremental_merge", str(tmp_path / "snap"), "UTC", "2026-03-10") == {"rows": 2, "new": 1, "retained": 1}
    assert sinks.write_snapshot(prev, nxt.limit(0), "replace", str(tmp_path / "snap"), "UTC", "2026-03-10")["rows"] == -1
    assert spark.read.parquet(str(tmp_path / "snap")).where(F.col("url") == "u1").count() == 1


def test_page_events_in_sql(spark):
    from plazafeed.sources import udtf

    udtf.register(spark)
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "A", "location": {"name": "V"}}, {"@type": "Person"}]}</script><script type="application/ld+json">broken</script>'
    page(spark, ld).createOrReplaceTempView("landed")
    assert [(r.title, r.venue) for r in spark.sql("SELECT e.* FROM landed, LATERAL page_events(html, url) e").collect()] == [("A", "V")]


def test_bounded_log(spark, tmp_path):
    """The newest events by time, then tie; a batch again adds nothing; old days go."""
    rows = [(k, datetime(2026, 1, 1 + k // 10, k % 3) if k % 13 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    order = lambda r: (r[1] or datetime(1970, 1, 1), r[0])
    for cap in (1, 17, 20, 55, 58, 60, 99):
        log = sinks.EventLog(spark, str(tmp_path / f"log{cap}"), cap, "event_id")
        for k in (0, 1, 0):
            log.append(df.where(F.col("event_id") % 2 == k), k)
        want = sorted(r[0] for r in sorted(rows, key=order, reverse=True)[:cap])
        assert sorted(r.event_id for r in log.newest().collect()) == want
        log.retire()
        assert sorted(r.event_id for r in log.newest().collect()) == want
    assert sinks.EventLog(spark, str(tmp_path / "log17"), 17, "event_id").rows().count() < 30

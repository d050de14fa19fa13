"""Operators on small hand-made frames with values worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plazafeed.functions import geo, keys, text
from plazafeed.functions.time import end_of_local_year, local_day_end, parse_date
from plazafeed.operators import analytics as A
from plazafeed.operators import dedupe as D
from plazafeed.operators import filters as P
from plazafeed.operators import joins as J
from plazafeed.operators import ranking as R

T = datetime
AS_OF = "2026-03-10 09:00:00"
TZ = "Europe/Moscow"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


ITEM = "id string, source_id string, type string, kind string, title string, summary string, venue_title string, url string, image_url string, event_date timestamp, event_has_explicit_time boolean, categories array<string>, source_ids array<string>, source_names array<string>, score double, base_score double, seen_at timestamp, updated_at timestamp"


def item(id, title, summary="", venue="", date=T(2026, 3, 12, 16, 0), explicit=True, kind="concert", source="a", **more):
    base = dict(id=id, source_id=source, type="html", kind=kind, title=title, summary=summary, venue_title=venue, url=f"https://x.test/{id}", image_url=None, event_date=date, event_has_explicit_time=explicit, categories=["events"], source_ids=[source], source_names=[source.upper()], score=10.0, base_score=10.0, seen_at=T(2026, 3, 1), updated_at=T(2026, 3, 1))
    return tuple((base | more).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


@pytest.mark.parametrize("s,want,explicit", [
    ("2026-05-12T19:30:00+03:00", T(2026, 5, 12, 16, 30), True), ("12.05.2026 19:30", T(2026, 5, 12, 16, 30), True), ("12 мая 2026", T(2026, 5, 12, 9, 0), False),
    ("12-15 мая", T(2026, 5, 12, 9, 0), False), ("3 января", T(2027, 1, 3, 9, 0), False), ("1 марта", T(2026, 3, 1, 9, 0), False), ("завтра в 20:00", T(2026, 3, 11, 17, 0), True), ("сегодня", T(2026, 3, 10, 9, 0), False),
])
def test_parse_date(spark, s, want, explicit):
    got = one(spark, parse_date(F.lit(s), AS_OF, TZ))
    assert (got.ts, got.explicit) == (want, explicit)


def test_parse_date_nothing(spark):
    assert one(spark, parse_date(F.lit("скоро"), AS_OF, TZ)) is None and one(spark, parse_date(F.lit(None).cast("string"), AS_OF, TZ)) is None


def test_local_days(spark):
    assert one(spark, local_day_end(F.lit("2026-03-10 22:30:00").cast("timestamp"), TZ)) == T(2026, 3, 11, 20, 59, 59, 999000)
    assert one(spark, end_of_local_year(F.lit("2026-03-10 22:30:00").cast("timestamp"), TZ)) == T(2026, 12, 31, 20, 59, 59, 999000)


def test_text(spark):
    assert one(spark, text.fingerprint_text(F.lit("Ёлка — «Шоу» 2026!"))) == "елка шоу 2026"
    assert one(spark, text.compact_text(F.lit("Ёлка — Шоу"))) == "ёлкашоу"
    assert one(spark, text.search_text(F.lit("Ｅvent № ½"))) == "event no 1 2"
    assert one(spark, text.tokens(F.lit("Большой концерт на Неве, большой"))) == ["большой", "неве"]
    assert one(spark, text.quoted_tokens(F.lit("Спектакль «Чайка» и шоу \"Лёд\""))) == ["чайка", "лед"]
    assert one(spark, text.trim_text(F.lit("Одно предложение здесь. Второе длиннее и не влезет."), 30)) == "Одно предложение здесь."
    assert one(spark, text.trim_text(F.lit("слово " * 20), 30)) == "слово слово слово."  # cut at a word, and a short last word goes too
    assert one(spark, text.whole_sentences(F.lit("Раз два. Три четыре. Пять."), 20)) == "Раз два. Три четыре."
    assert one(spark, text.strip_html(F.lit("<p>A&amp;B<script>x</script> c</p>"))) == "A&B c"
    assert one(spark, text.clean_title(F.lit("19:30 Концерт | Афиша"))) == "Концерт"
    garbled = "Концерт в парке сегодня".encode().decode("cp1251")
    assert one(spark, text.is_mojibake(F.lit(garbled))) and not one(spark, text.is_mojibake(F.lit("Рассказ о Москве")))
    assert spark.createDataFrame([(garbled,), ("Рассказ",)], "s string").select(text.repair_mojibake(F.col("s")).alias("s")).collect()[0].s == "Концерт в парке сегодня"
    assert one(spark, text.parse_links(F.lit("Фото|https://a.test\nhttps://b.test"))) == [("Фото", "https://a.test"), ("", "https://b.test")]


def fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    d = ""
    while h:
        h, r = divmod(h, 36)
        d = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + d
    return d


def test_keys(spark):
    assert one(spark, keys.fnv36(F.lit("концерт|2026"))) == fnv("концерт|2026")
    assert one(spark, keys.canonical_url(F.lit("https://A.test/x/?q=1#top"))) == "https://a.test/x"
    assert one(spark, keys.sorted_query_url(F.lit("https://a.test/x/?b=2&a=1#t"))) == "https://a.test/x?a=1&b=2"
    assert one(spark, keys.absolute_url(F.lit("/b"), F.lit("https://a.test/c/d"))) == "https://a.test/b"
    assert one(spark, keys.absolute_url(F.lit("b"), F.lit("https://a.test/c/d?x"))) == "https://a.test/c/b"
    assert one(spark, keys.is_private_host(keys.host(F.lit("http://192.168.1.2:80/x")))) and not one(spark, keys.is_private_host(keys.host(F.lit("https://a.test/"))))
    assert one(spark, keys.is_clean_image(F.lit("https://a.test/p.jpg"))) and not one(spark, keys.is_clean_image(F.lit("https://a.test/%6Cogo.jpg")))


def test_geo(spark):
    assert abs(one(spark, geo.haversine_m(F.lit(55.0), F.lit(49.0), F.lit(56.0), F.lit(49.0))) - 111194.9) < 1
    assert abs(one(spark, geo.to_segment_m(F.lit(55.01), F.lit(49.0), F.lit(55.0), F.lit(48.9), F.lit(55.0), F.lit(49.1))) - 1111.9) < 2
    assert one(spark, geo.distance_label(F.lit(444.0))) == "440 м" and one(spark, geo.distance_label(F.lit(1550.0))) == "1.6 км"


def test_filters(spark):
    df = frame(spark, item("a", "Концерт"), item("b", "Розыгрыш билетов"), item("c", "Вчера", date=T(2026, 3, 10, 8, 0)), item("d", "Сегодня без времени", date=T(2026, 3, 10, 8, 0), explicit=False), item("e", "Без даты", date=None))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(P.in_allowed_window(df, AS_OF, "2026-03-10 00:00:00", "2026-04-01 00:00:00")) == ["a", "d"]
    assert ids(P.drop_expired(df, AS_OF, TZ)) == ["a", "b", "d"]
    assert ids(P.within_days(df, F.col("event_date"), 7, AS_OF)) == ["a", "b", "c", "d", "e"] and ids(P.within_days(df, F.col("event_date"), 1, AS_OF)) == ["c", "d"]
    scored = df.withColumn("source_count", F.lit(1)).withColumn("priority_score", F.when(F.col("id") == "a", 90.0).otherwise(1.0))
    assert ids(P.match_categories(scored, ["expected"])) == ["a"] and ids(P.match_categories(scored, ["sport"])) == [] and len(ids(P.match_categories(scored, ["all"]))) == 5
    assert ids(P.search(df, "БИЛЕТ", ["title"])) == ["b"] and ids(P.drop_outside_area(df, ["розыгрыш"])) == ["a", "c", "d", "e"]
    secrets = spark.createDataFrame([(1, "x\nAPI_KEY = abcdef123456\nTOKEN=your_token_here"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.line, r.key) for r in P.scan_secrets(secrets).collect()] == [(1, 1, "API_KEY")]


def test_resolve_range(spark):
    p = spark.createDataFrame([(T(2026, 3, 1), T(2026, 12, 31), T(2026, 5, 9), T(2026, 5, 1), None), (T(2026, 3, 1), T(2026, 12, 31), None, None, "3days"), (T(2026, 3, 1), T(2026, 12, 31), T(2027, 5, 9), T(2027, 5, 1), None)], "allowed_from timestamp, allowed_to timestamp, req_from timestamp, req_to timestamp, preset string")
    r = [(x.from_ts, x.to_ts) for x in P.resolve_range(p, AS_OF, TZ).collect()]
    assert r[0] == (T(2026, 5, 1), T(2026, 5, 9)) and r[1] == (T(2026, 3, 9, 21), T(2026, 3, 12, 20, 59, 59, 999000)) and r[2] == (T(2027, 5, 1), T(2027, 5, 1))


SAME = "Вечер живой музыки с оркестром под открытым небом у воды"


def groups(df, mode):
    return sorted(tuple(sorted(x[len("https://x.test/"):] for x in r.duplicate_urls)) for r in D.collapse(df, TZ, mode).collect())


@pytest.mark.parametrize("mode", ["components", "fold"])
def test_collapse(spark, mode):
    df = frame(
        spark,
        item("a1", "Симфонический оркестр играет Баха", SAME, "Филармония"), item("a2", "Симфонический оркестр играет Баха", SAME, "Филармония", source="b"),
        item("b1", "Симфонический оркестр играет Баха", SAME, "Филармония", date=T(2026, 3, 13, 16)), item("c1", "Балет «Лебединое озеро»", "", "Театр", kind="theatre"),
        item("c2", "«Лебединое озеро» на сцене", "", "", kind="theatre", source="c"), item("d1", "Матч дружбы городов Север", "", "Арена", kind="sport"), item("d2", "Выставка дружбы городов Север", "", "Арена", kind="exhibition"),
        item("e1", "Джаз на крыше", SAME, "Бар"), item("e2", "Мастерская керамики", SAME, "Бар"),
    )
    assert groups(df, mode) == [("a1", "a2"), ("b1",), ("c1", "c2"), ("d1",), ("d2",), ("e1",), ("e2",)]


def test_merge_group(spark):
    df = frame(spark, item("1", "Концерт 12 марта", "Короткий.", base_score=50.0), item("2", "Концерт", "Подробное описание концерта, длинное.", source="b", explicit=False, date=T(2026, 3, 12, 9), image_url="https://x.test/p.jpg")).withColumn("g", F.lit("g"))
    r = D.merge_group(df, "g").first()
    assert (r.id, r.title, r.summary, r.image_url) == ("1", "Концерт 12 марта", "Подробное описание концерта, длинное.", "https://x.test/p.jpg")
    assert (r.event_date, r.event_has_explicit_time, r.source_ids, r.source_count, r.priority_score) == (T(2026, 3, 12, 16), True, ["a", "b"], 2, 56.0)


def test_upsert_and_snapshots(spark):
    old = spark.createDataFrame([("1", "t", T(2026, 1, 1), T(2026, 1, 1)), ("2", "u", T(2026, 1, 2), T(2026, 1, 2))], "id string, title string, seen_at timestamp, updated_at timestamp")
    got = {r.id: (r.title, r.seen_at, r.updated_at) for r in D.upsert(old, spark.createDataFrame([("2", "v"), ("3", "w")], "id string, title string"), AS_OF).collect()}
    now = T(2026, 3, 10, 9)
    assert got == {"1": ("t", T(2026, 1, 1), T(2026, 1, 1)), "2": ("v", T(2026, 1, 2), now), "3": ("w", now, now)}
    a = frame(spark, item("1", "А", "длинное описание"), item("2", "Б"))
    b = frame(spark, item("1", "А!", "кратко"), item("3", "В"))
    m = {r.id: (r.title, r.summary, r.merge_state) for r in D.merge_snapshots(a, b, TZ).collect()}
    assert m == {"1": ("А!", "длинное описание", "updated"), "2": ("Б", "", "retained"), "3": ("В", "", "new")}


def test_any_key_and_drafts(spark):
    df = spark.createDataFrame([(1, "x", ""), (2, "x", "p"), (3, "", "p"), (4, "", "")], "id int, k1 string, k2 string")
    assert {r.id: r.group for r in D.dedupe_any_key(df, "id", ["k1", "k2"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    drafts = spark.createDataFrame([("a", "i1", "s1", "pending", T(2026, 3, 10)), ("b", "i2", "s1", "pending", T(2026, 3, 10, 1)), ("c", "i3", "s3", "pending", T(2026, 3, 8)), ("d", "i4", "s4", "published", T(2026, 1, 1))], "id string, item_id string, event_signature string, status string, created_at timestamp")
    assert {r.id: r.status for r in D.expire_drafts(drafts, AS_OF).collect()} == {"a": "pending", "b": "expired", "c": "expired", "d": "published"}


def test_joins(spark):
    items = spark.createDataFrame([("1", "t"), ("2", "u")], "id string, title string")
    joined, missing = J.with_manifest(items, spark.createDataFrame([("1", "x")], "id string, official string"))
    assert joined.count() == 2 and [r.id for r in missing.collect()] == ["2"]
    cat = spark.createDataFrame([("s", "1", "a", "b"), ("s", "2", "c", "d")], "section_id string, item_id string, title string, note string")
    over = spark.createDataFrame([("s", "1", ("z", None)), ("s", "9", ("q", None))], "section_id string, item_id string, patch struct<title:string,note:string>")
    assert sorted((r.item_id, r.title, r.note) for r in J.apply_overrides(cat, over).collect()) == [("1", "z", "b"), ("2", "c", "d")]
    routes = spark.createDataFrame([("r", [(55.0, 49.0), (55.0, 49.1)])], "route_id string, stops array<struct<lat:double,lng:double>>")
    places = spark.createDataFrame([("p", 55.005, 49.05), ("q", 55.5, 49.05), ("s", 55.0, 49.12)], "place_id string, lat double, lng double")
    assert [(r.place_id, round(r.distance_m)) for r in J.near_route(routes, places).orderBy("rn").collect()] == [("p", 556), ("s", 1276)]
    stops = spark.createDataFrame([("Кремль",), ("У фонтана в парке",), ("нигде",)], "stop string")
    gaz = spark.createDataFrame([(1, "кремль", 55.8, 49.1), (2, "фонтан", 55.7, 49.2)], "ord int, place_key string, lat double, lng double")
    assert {r.stop: r.coord and r.coord.lat for r in J.geocode(stops, gaz).collect()} == {"Кремль": 55.8, "У фонтана в парке": 55.7, "нигде": None}
    new = spark.createDataFrame([("s", "i", "https://a.test/1.jpg?x")], "section_id string, item_id string, photo_url string")
    old = spark.createDataFrame([("s", "i", "https://a.test/1.jpg", "approved")], "section_id string, item_id string, photo_url string, status string")
    assert J.duplicate_reviews(new, old).count() == 1
    fav = spark.createDataFrame([("u", "place", "1", ""), ("u", "event", "9", "old")], "user_id string, type string, favorite_id string, title string")
    got = {r.favorite_id: (r.title, r.available) for r in J.enrich_favorites(fav, place=spark.createDataFrame([("1", "Парк", "https://p")], "id string, title string, url string")).collect()}
    assert got == {"1": ("Парк", True), "9": ("old", False)}


def test_photos(spark):
    c = spark.createDataFrame([("s", "i", "https://good.test/photo/a.jpg", 100000, 1200, 700), ("s", "i", "https://bad.test/logo.png", 9000, 100, 300)], "section_id string, item_id string, url string, bytes long, width int, height int")
    f = spark.createDataFrame([("https://good.test/photo/a.jpg", "approved")], "url_key string, action string")
    r = {x.url[-5:]: (x.photo_score, x.needs_note) for x in R.score_photos(J.photo_feedback(c, f, ["good.test"], ["bad.test"])).collect()}
    assert r == {"a.jpg": (100, False), "o.png": (0, True)}


def test_selection(spark):
    rows = [item(str(k), f"Программа {'абвгдежзик'[k] * 4} большая", venue=f"Зал {k}", kind="concert" if k < 6 else "sport" if k < 8 else "theatre") for k in range(10)]
    df = D.with_signatures(frame(spark, *rows), TZ).withColumn("editorial_score", 100.0 - F.col("id").cast("double")).withColumn("item_id", F.col("id")).withColumn("event_signature", F.col("exact_signature")).withColumn("event_loose_signature", F.col("loose_signature"))
    none = spark.createDataFrame([], "draft_id string, item_id string, posted_at timestamp")
    posted = spark.createDataFrame([("d", "0", T(2026, 3, 9))], "draft_id string, item_id string, posted_at timestamp")
    got = [r.id for r in R.select_batch(df, posted, none, 4, AS_OF).collect()]
    assert len(got) == 4 and "0" not in got and {"1", "6", "8"} <= set(got)


def test_audit_and_registry(spark):
    df = D.with_signatures(frame(spark, item("1", "A" * 130, "x"), item("2", "Хороший концерт", SAME, "Зал"), item("3", "Хороший концерт", SAME, "Зал", source="b")), TZ).withColumn("visual_key", F.col("id"))
    r = A.content_audit(df, AS_OF).first()
    assert (r["items"], r.weak_title, r.weak_summary, r.missing_venue, r.duplicate_groups, r.duplicate_rows, r.ok) == (3, 1, 1, 1, 1, 2, False)
    reg = spark.createDataFrame([("a", "A", "html", "u", True), ("a", "B", "html", "u", True), ("b", "", "rss", "", True), ("c", "C", "rss", "", False)], "id string, name string, type string, url string, enabled boolean")
    assert sorted((r.id, r.code) for r in A.validate_registry(reg).collect()) == [("a", "duplicate_id"), ("b", "enabled_without_url"), ("b", "no_name")]
    meta = spark.createDataFrame([(T(2026, 3, 9), T(2026, 3, 9), 4, 0, 3, 10, 5), (None, None, 0, 4, 12, 10, 6), (T(2026, 3, 10), T(2026, 3, 1), 9, 10, 2, 2, 2)], "last_event_scan timestamp, last_catalog_scan timestamp, created int, delivered int, ready_count int, target int, unique_photos int")
    found = [sorted(r.code for r in A.health_warnings(meta.where(c), AS_OF).collect()) for c in ("created = 4", "created = 0", "created = 9")]
    assert found == [["draft_candidates_low", "draft_delivery_failed", "draft_visuals_low", "drafts_today", "events_stale"], ["drafts_today_incomplete"], ["catalog_stale"]]
    assert [A.overall_status(w).first().status for w in (A.health_warnings(meta, AS_OF), A.health_warnings(meta.limit(0), AS_OF))] == ["warning", "ok"]


def test_plans(spark):
    cat = spark.createDataFrame([("parks", 1, "park1"), ("food", 1, "cafe1")], "section string, rank int, item string")
    ev = spark.createDataFrame([(1, "show1")], "rank int, item string")
    slots = spark.createDataFrame([(1, 1, "am", 0, "sights", 1), (1, 1, "am", 1, "parks", 1), (1, 1, "pm", 0, "events", 1)], "days int, day int, slot string, pref_ord int, section string, rank int")
    assert sorted((r.slot, r.item) for r in R.trip_plans(cat, ev, slots).collect()) == [("am", "park1"), ("pm", "show1")]
    plan = spark.createDataFrame([(1, k, f"i{k}", ["art"] if k == 3 else ["food"]) for k in range(5)], "day int, pos int, item string, tags array<string>")
    prefs = spark.createDataFrame([("u", "calm", "art", 5)], "user_id string, pace string, tag string, weight int")
    assert [r["item"] for r in R.personalize(plan, prefs).orderBy("rn").collect()] == ["i3", "i0"]
    r = spark.createDataFrame([([*"abcdefgh"],), (["a", "кафе", "c", "вид", "e", "f", "g", "h"],)], "stops array<string>")
    assert [x.stops for x in R.sample_stops(r).collect()] == [["a", "h"], ["a", "кафе", "вид", "h"]]


def test_copy(spark):
    from plazafeed.functions import copy

    at = F.lit("2026-03-12 16:00:00").cast("timestamp")
    got = one(spark, copy.post_text(F.lit("Название"), F.lit(""), F.lit("Зал"), at, F.lit(True), F.lit("concert"), F.lit("https://u"), TZ))
    assert got == "Название\n\nЖивая музыка\n\n12.03.2026 19:00, Зал\n\nhttps://u"
    assert one(spark, copy.reminder_text(F.lit("Название"), F.lit("1h"), at, TZ)) == "Напоминание: Название — через час, 12.03 19:00"
    p = spark.createDataFrame([((" длинный ", "", ["a", " ", "b" * 50]),)], "p struct<title:string,note:string,tags:array<string>>")
    r = p.select(copy.sanitize_patch(F.col("p"), {"title": 5, "note": 10}, {"tags": 3}).alias("p")).first().p
    assert (r.title, r.note, r.tags) == ("длинн", None, ["a", "bbb"])


def test_contained_keys_are_found_anywhere(spark):
    """The reference compares by ``includes``: a key counts in mid-word and across words."""
    texts = [(1, "old supermarket"), (2, "mar ket place"), (3, "old supermarket"), (4, ""), (5, None), (6, "a"), (7, "😀é market 😀é")]
    keys = [(1, "market"), (2, "ket pl"), (3, "a"), (4, ""), (5, None), (6, "supermarket hall"), (7, "😀é"), (8, "old supermarket"), (9, "upermarke")]
    got = J.contained_keys(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(keys, "key_id int, key string"), 4)
    assert sorted((r.text_id, r.key_id) for r in got.collect()) == sorted((i, k) for i, t in texts for k, w in keys if t and w and w in t)
    none = J.contained_keys(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([], "key_id int, key string"))
    assert none.count() == 0


def test_geocode_by_rule(spark):
    stops = [("Кремль",), ("Старый «Крем»ль: вид",), ("метро Кремлевская",), ("", ), (None,), ("нет",)]
    gaz = [(1, "метро кремлевская", 1.0), (1, "кремлевская", 1.0), (2, "казанский кремль", 2.0), (2, "кремль", 2.0), (3, "кремл", 3.0), (4, "кремль", 4.0)]
    got = J.geocode(spark.createDataFrame(stops, "stop string"), spark.createDataFrame([(*g, 0.0) for g in gaz], "ord int, place_key string, lat double, lng double"))
    assert sorted(((r.stop or ""), r.coord and r.coord.lat) for r in got.collect()) == sorted([("Кремль", 2.0), ("Старый «Крем»ль: вид", 2.0), ("метро Кремлевская", 1.0), ("", None), ("", None), ("нет", None)], key=lambda x: (x[0], str(x[1])))


def test_affinity_and_misc_joins(spark):
    routes = spark.createDataFrame([("r", "Прогулка по Бауманской: кофейни и «Чай» хаус"), ("s", "ничего")], "route_id string, text string")
    places = spark.createDataFrame([("p", "чай хаус", "на баумана"), ("q", "Бар", "кофе"), ("w", "", "кофе на баумана"), ("x", "X", "far"), ("y", "Y", "")], "place_id string, title string, text string")
    tokens = spark.createDataFrame([("бауман", 3), ("кофе", 1)], "token string, weight int")
    reach = spark.createDataFrame([("r", "x", 700.0), ("s", "y", 1499.6), ("r", "q", 1400.0)], "route_id string, place_id string, distance_m double")
    aff = J.route_affinity(routes, places, tokens, reach, 9)
    # 3 an area and 5 the title; 1 an intent and 1 in reach; 3 + 1; in reach alone: (1600 - 700) / 200 rounded up at the half, and 1 at least
    want = {("r", "p"): (8, None), ("r", "q"): (2, 1400), ("r", "w"): (4, None), ("r", "x"): (5, 700), ("s", "y"): (1, 1500)}
    assert {(r.route_id, r.place_id): (r.score, r.distance_m) for r in aff.collect()} == want
    aff = J.route_affinity(routes, places, tokens, reach, 2).where("route_id = 'r'")
    assert [r.place_id for r in aff.orderBy("rn").collect()] == ["p", "x"]
    near = spark.createDataFrame([("r", "z", 10.0, 1)], "route_id string, place_id string, distance_m double, rn int")
    assert [r.place_id for r in J.top_up_route(near, aff).orderBy("rn").collect()] == ["z", "p", "x"]
    ap = spark.createDataFrame([("s", "i", "a", True), ("s", "i", "b", True), ("s", "i", "c", False), ("s", "i", "d", True)], "section_id string, item_id string, file string, approved boolean")
    files = ap.where("file in ('a', 'd')").drop("approved")
    assert {r.file: r.result for r in J.approval_status(ap, files, files.where("file = 'd'")).collect()} == {"a": "ready", "b": "error", "c": "skipped", "d": "applied"}
    items = spark.createDataFrame([("s1", "", ["events", "sport"], "", None, "concert"), ("s2", "", ["events"], "", None, "concert")], "source_id string, section string, categories array<string>, url string, source_name string, kind string")
    src = spark.createDataFrame([("s1", "One", "x")], "id string, name string, section string")
    assert sorted((r.source_name, r.section) for r in J.with_source_section(items, src).collect()) == [("One", "sport"), ("s2", "concert")]
    drafts = spark.createDataFrame([("d", "1", "", "", "")], "id string, item_id string, title string, text string, photo_url string")
    it = spark.createDataFrame([("1", "T", "S", "https://i", "u", T(2026, 1, 1))], "id string, title string, summary string, image_url string, url string, event_date timestamp")
    r = J.hydrate_drafts(drafts, it).first()
    assert (r.title, r.text, r.photo_url) == ("T", "T\n\nS", "https://i")


def greedy(rows, limit, tiers, posted):
    """select_batch as plain loops; rows: (id, kind, score, marks), posted: {mark: days ago}."""
    kinds = R.rules.PREFERRED_KINDS
    base = -(-limit // 3)
    quota = {k: base + 1 if k == "concert" else base if k in ("sport", "theatre", "show", "standup") else max(1, base - 1) for k in kinds}
    picked, seen, counts = [], set(), {}
    for days in tiers:
        fit = sorted((r for r in rows if not any(posted.get(m, 99) < days for m in r[3])), key=lambda r: (-r[2], r[0]))
        free = lambda r: r[0] not in picked and not seen & r[3]  # noqa: E731, B023

        def take(r):
            picked.append(r[0])
            seen.update(r[3])
            counts[r[1]] = counts.get(r[1], 0) + 1

        for k in kinds:
            m = next((r for r in fit if r[1] == k and free(r) and not counts.get(k)), None)
            if m and len(picked) < limit:
                take(m)
        for r in fit:
            if len(picked) < limit and free(r) and counts.get(r[1], 0) < quota.get(r[1], base):
                take(r)
        for r in fit:
            if len(picked) < limit and free(r):
                take(r)
    return picked


@pytest.mark.parametrize("limit", [5, 12])
def test_batch_is_the_greedy_choice(spark, limit):
    """Sixty rows of one title and a few others, repeats of identities and visuals, cool-downs."""
    import random

    r = random.Random(limit)
    data, plain = [], []
    for k in range(90):
        kind = r.choice(["concert", "concert", "sport", "theatre", "quiz", None])
        title = "Same" if k < 60 else f"Title {k % 17}"
        sign, image = f"s{r.randrange(70)}" if k >= 60 else f"own{k}", f"https://i.test/{r.randrange(80)}.jpg" if k >= 60 else f"https://i.test/x{k}.jpg"
        score = float(500 - k if k < 60 else r.randrange(300))
        data.append((f"{k:03d}", f"i{k}", kind, title, "", image, sign, title.lower(), "2026-03-12", score))
        plain.append((f"{k:03d}", kind or "other", score, {f"i:{k}", f"e:{sign}", f"v:{image}", f"d:{title}"}))
    df = spark.createDataFrame(data, "id string, item_id string, kind string, title string, venue_title string, image_url string, event_signature string, title_key string, date_key string, editorial_score double")
    days = {f"s{k}": k % 6 for k in range(40)}
    posted = spark.createDataFrame([(f"d{s}", "none", s, T(2026, 3, 10 - n, 8)) for s, n in days.items()], "draft_id string, item_id string, event_signature string, posted_at timestamp")
    none = posted.limit(0)
    got = [x.id for x in R.select_batch(df, posted, none, limit, AS_OF).orderBy("pos").collect()]
    assert got == greedy(plain, limit, (4, 2, 1, 0), {f"e:{s}": n + 0.01 for s, n in days.items()}) and len(got) == limit


def test_fold_is_the_plain_reading(spark, monkeypatch):
    """The rule read plainly compares each row with every group of its date (worker/src/index.js, collapseDuplicateItems)."""
    import random

    r = random.Random(4)
    words = [f"слово{k}" for k in range(14)]
    rows = []
    for k in range(260):
        title = " ".join(r.sample(words, r.randrange(1, 5)))
        if r.random() < 0.3:
            title = f"«{r.choice(words)} {r.choice(words)}» " + title
        rows.append((f"{k:03d}", title, " ".join(r.sample(words, r.randrange(0, 6))), r.choice(["", "Зал", "Зал два", "Клуб"]), r.choice(["concert", "sport", None]), T(2026, 3, r.choice([12, 12, 13]), r.randrange(24)), r.random() < 0.5))
    items = spark.createDataFrame(rows, "id string, title string, summary string, venue_title string, kind string, event_date timestamp, event_has_explicit_time boolean").withColumn("url", F.col("id"))
    signed = D.with_signatures(items, "UTC")
    clock = F.when(F.col("event_has_explicit_time"), D.time_key(F.col("event_date"), "UTC")).otherwise("no-time")
    rated = signed.withColumns({"title_q": D.text.title_quality(F.col("title")), "summary_q": D.text.summary_quality(F.col("summary")), "venue_q": D.text.text_quality(F.col("venue_title")), "clock": clock}).select(*D._FOLDED)
    got = {x.id: x.root for x in D.fold_groups(rated).collect()}
    monkeypatch.setattr(D._Groups, "near", lambda self, r: range(len(self.heads)))
    plain = rated.withColumn("part", F.col("date_key")).orderBy("part", "id").toPandas()
    want = {i: root for pdf in D._fold(iter([plain])) for i, root in zip(pdf["id"], pdf["root"])}
    assert got == want and 20 < len(set(got.values())) < 240


@pytest.mark.parametrize("limit", [20, 60])
def test_trim_text_computes_its_parts_once(spark, limit):
    """The plan names the normalised text and the head; without that it held more than a hundred replacements."""
    df = spark.createDataFrame([("Первое предложение. Второе, г. Казань, очень длинное и без конца, " * 3,)], "s string").select(text.trim_text(F.col("s"), limit).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 60
    assert len(df.first().t) <= limit + 1


def test_repair_without_python(spark):
    garbled = "Концерт в парке сегодня".encode().decode("cp1251", "ignore")
    rows = [("Концерт в театре".encode().decode("cp1251"),), ("Рассказ",), (garbled + "é日",), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string").select("s", text.repair_mojibake(F.col("s")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in df.collect()] == ["Концерт в театре", "Рассказ", rows[2][0], None, ""]

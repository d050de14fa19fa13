"""Word lists, maps and weights that results depend on."""

#: Classifier keywords by category.
CATEGORY_KEYWORDS = {
    "events": ["афиша", "концерт", "выставка", "спектакль", "лекция", "маркет", "фестиваль", "вечеринка", "мастер-класс", "сегодня", "завтра", "выходные"],
    "new_places": ["открыл", "открытие", "новое место", "новый ресторан", "новый бар", "запустил", "появил"],
    "restaurants": ["ресторан", "завтрак", "ужин", "бранч", "кухня", "шеф", "меню", "кафе", "бистро"],
    "bars": ["бар", "коктейль", "speakeasy", "секретный бар", "винная", "настойки"],
    "viewpoints": ["панорама", "вид на", "смотровая", "крыша", "закат", "набережная", "колесо обозрения"],
    "hidden": ["секрет", "неочевид", "скрыт", "двор", "тропа", "маршрут", "локальное место", "для своих"],
}
#: Letters and keywords that reject a text.
BLOCKED_LETTERS = "ӘәӨөҮүҢңҖҗҺһ"
BLOCKED_KEYWORDS = ["розыгрыш", "авиабилет", "авиабилеты", "самолет", "самолёт"]
#: Words without weight in fingerprints.
STOP_WORDS = ["казань", "казани", "город", "сегодня", "завтра", "апрель", "апреля", "афиша", "мероприятие", "событие", "концерт", "выставка", "лекция", "фестиваль", "спектакль", "билеты", "билет", "начало", "клуб", "центр", "пространство", "вечер", "день"]
#: Kind by the words that sources use, and the family under which kinds match.
KIND_OF = {
    "concert": "concert", "concerts": "concert", "concert_popular": "concert", "theatre": "theatre", "theater": "theatre", "theatre_show": "theatre",
    "spectacle": "theatre", "spectacle_popular": "theatre", "monoperformance": "theatre", "show": "show", "circus_show": "show", "show_and_musicals": "show",
    "festival": "festival", "standup": "standup", "exhibition": "exhibition", "exhibitions": "exhibition", "art": "exhibition", "excursion": "excursion",
    "excursions": "excursion", "musical": "musical", "musicals": "musical", "sport": "sport", "sports": "sport", "kids": "kids", "children": "kids",
}
KIND_FAMILY = {
    "show": "show", "festival": "show", "circus_show": "show", "musical": "show", "kids": "show", "theatre": "theatre", "theatre_show": "theatre",
    "monoperformance": "theatre", "exhibition": "exhibition", "art": "exhibition", "excursion": "excursion", "excursions": "excursion", "sport": "sport",
    "sports": "sport", "concert": "concert", "standup": "standup",
}
#: Editorial points by kind, and by days ahead (upper bound, points).
KIND_POINTS = {"concert": 90, "sport": 88, "theatre": 82, "standup": 76, "show": 74, "festival": 72, "musical": 68, "excursion": 60, "exhibition": 54, "kids": 36}
DATE_POINTS = [(0.125, -80), (1, 26), (3, 78), (7, 92), (21, 74), (45, 58), (90, 30), (180, 8)]
#: Kinds in the order a batch prefers them.
PREFERRED_KINDS = ["concert", "sport", "theatre", "show", "standup", "festival", "excursion", "exhibition", "musical", "kids"]
#: Markers of branded images, and of decorative ones.
BRAND_MARKERS = ["wmark", "watermark", "tickets", "ticket", "logo", "banner", "poster", "announce", "1200x628_wmark", "generated/events", "/brand/"]
DECORATIVE_MARKERS = ["logo", "favicon", "icon", "watermark", ".svg"]
#: Months in the genitive, for dates in texts.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
#: Key names whose values are secrets, and values that are placeholders.
SECRET_KEYS = ["TOKEN", "SECRET", "PASSWORD", "API_KEY", "PRIVATE_KEY", "ACCESS_KEY"]
PLACEHOLDERS = ["example", "changeme", "placeholder", "your_", "xxx", "<", "process.env", "test"]
#: Places outside the area, by what their names begin with in titles, venues and addresses.
OUTSIDE_AREA = ["chistopol", "zelenodolsk", "almet", "nizhnekamsk", "naberezhn", "elabug", "bugulm", "leninogorsk", "buinsk", "yoshkar", "ulyanovsk", "чистопол", "зеленодоль", "альмет", "нижнекам", "набережн", "елабуг", "бугульм", "лениногор", "буинск", "йошкар", "ульяновск"]
#: A week's plan. Of each day its slots in order, and for each the sections and places (from 1) that are tried.
TRIP_WEEK = [
    [["excursions 1"], ["food 1"], ["routes 1"], ["events 1", "sights 1"]],
    [["sights 1"], ["food 2", "food 1"], ["parks 1"], ["events 2", "excursions 2"]],
    [["active 1"], ["food 3", "food 1"], ["masterclasses 1", "routes 2", "routes 1"], ["events 3", "active 2"]],
    [["sights 2", "sights 1"], ["parks 2", "parks 1"], ["food 4", "food 2", "food 1"], ["masterclasses 2", "events 4", "excursions 3", "sights 3"]],
    [["roadtrip 1"], ["food 5", "food 3", "food 1"], ["roadtrip 2", "active 2"], ["events 5", "parks 3", "sights 3"]],
    [["routes 3", "routes 1"], ["food 1"], ["masterclasses 3", "active 3", "parks 1"], ["events 6", "sights 4", "excursions 1"]],
    [["sights 4", "sights 1"], ["parks 1"], ["food 2", "food 1"], ["events 7", "roadtrip 3", "excursions 1"]],
]

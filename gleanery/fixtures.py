"""Small fixed inputs of the registered queries, as rows that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as an SQL ``VALUES`` list, aliased ``v(columns)``."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns})"


KV = "key string, value string"

# Inputs whose results are known.
NCDC = [
    ("000", "006701199099999 1950 0515070049999999N9 +0000 1+9999"),
    ("106", "004301199099999 1950 0515120049999999N9 +0022 1+9999"),
    ("212", "004301199099999 1950 0515180049999999N9 -0011 1+9999"),
    ("318", "004301265099999 1949 0324120040500001N9 +0111 1+9999"),
    ("424", "004301265099999 1949 0324180040500001N9 +0078 1+9999"),
]
MONTHS = [
    ("001", "006701199099999 1950 0515070049999999N9 +0000 1+9999"),
    ("002", "004301199099999 1950 0515120049999999N9 +0022 1+9999"),
    ("003", "004301199099999 1950 0615180049999999N9 +0035 1+9999"),
    ("004", "004301265099999 1949 0324120040500001N9 +0111 1+9999"),
    ("005", "004301265099999 1949 0324180040500001N9 +0078 1+9999"),
    ("006", "004301265099999 1949 0724180040500001N9 +0128 1+9999"),
]
QUOTES = [
    ("stock1", '{"company":"AAPL","date":"2023-01-05","price":130.73}'),
    ("stock2", '{"company":"AAPL","date":"2023-01-06","price":129.62}'),
    ("stock3", '{"company":"MSFT","date":"2023-01-05","price":229.10}'),
    ("stock4", '{"company":"MSFT","date":"2023-01-06","price":224.93}'),
    ("stock5", '{"company":"GOOG","date":"2023-01-05","price":88.23}'),
    ("stock6", '{"company":"GOOG","date":"2023-01-06","price":89.87}'),
    ("stock7", '{"company":"AAPL","date":"2023-01-07","price":133.41}'),
]
SALES = [
    ("sale1", '{"id":"12345","category":"Electronics","product":"Smartphone","price":599.99,"quantity":1}'),
    ("sale2", '{"id":"12346","category":"Electronics","product":"Headphones","price":149.99,"quantity":2}'),
    ("sale3", '{"id":"12347","category":"Clothing","product":"T-Shirt","price":24.99,"quantity":3}'),
    ("sale4", '{"id":"12348","category":"Books","product":"Novel","price":15.99,"quantity":2}'),
    ("sale5", '{"id":"12349","category":"Electronics","product":"Tablet","price":349.99,"quantity":1}'),
    ("sale6", '{"id":"12350","category":"Clothing","product":"Jeans","price":49.99,"quantity":1}'),
    ("sale7", '{"id":"12351","category":"Books","product":"Cookbook","price":29.99,"quantity":1}'),
    ("sale8", '{"id":"12352","category":"Electronics","product":"Smartwatch","price":199.99,"quantity":1}'),
]
WEBLOG = [
    ("log1", '192.168.1.1 - - [01/Jan/2023:12:34:56 +0000] "GET /index.html HTTP/1.1" 200 2326'),
    ("log2", '192.168.1.2 - - [01/Jan/2023:12:35:21 +0000] "GET /images/logo.png HTTP/1.1" 200 4532'),
    ("log3", '192.168.1.3 - - [01/Jan/2023:12:36:45 +0000] "GET /nonexistent.html HTTP/1.1" 404 1024'),
    ("log4", '192.168.1.4 - - [01/Jan/2023:12:37:12 +0000] "POST /api/login HTTP/1.1" 401 543'),
    ("log5", '192.168.1.5 - - [01/Jan/2023:12:38:03 +0000] "GET /about.html HTTP/1.1" 200 3241'),
    ("log6", '192.168.1.6 - - [01/Jan/2023:12:39:27 +0000] "POST /api/data HTTP/1.1" 500 872'),
    ("log7", '192.168.1.7 - - [01/Jan/2023:12:40:59 +0000] "GET /contact.html HTTP/1.1" 200 1978'),
    ("log8", '192.168.1.8 - - [01/Jan/2023:12:41:33 +0000] "GET /old-page.html HTTP/1.1" 301 321'),
]
LINES = [
    ("b1-l1", "It was the best of times, it was the worst of times,"),
    ("b1-l2", "it was the age of wisdom, it was the age of foolishness,"),
    ("b1-l3", "it was the epoch of belief, it was the epoch of incredulity,"),
    ("b1-l4", "it was the season of Light, it was the season of Darkness,"),
    ("b1-l5", "it was the spring of hope, it was the winter of despair,"),
]
LEARNING = [("doc1", "machine learning is amazing"), ("doc2", "deep learning powers amazing systems"), ("doc3", "machine learning and deep learning are related")]
MAIL = [
    ("doc1", "Contact us at support@example.com for customer service."),
    ("doc2", "Please call us at (555) 123-4567 for assistance."),
    ("doc3", "Visit our website at https://www.example.com for more information."),
    ("doc4", "Product ID: ABC-123-XYZ is currently out of stock."),
    ("doc5", "Meeting scheduled for 2023-04-15 at 3:00 PM."),
    ("doc6", "Send your resume to careers@example.org to apply."),
    ("doc7", "Use coupon code SUMMER25 for 25% off your order."),
    ("doc8", "Reply to john.doe@company.co.uk with your feedback."),
    ("doc9", "The file is stored at /users/data/report.pdf"),
    ("doc10", "Username: user123, Password: ********"),
]
HOSTS = [
    ("www.blog.com", "www.reference.com www.news.com www.wikipedia.org"),
    ("www.news.com", "www.blog.com www.sports.com www.weather.com"),
    ("www.sports.com", "www.news.com www.stats.com"),
    ("www.university.edu", "www.library.org www.research.org www.blog.com"),
    ("www.tech.org", "www.gadgets.com www.reviews.com"),
    ("www.travel.com", "www.hotels.com www.flights.com www.blog.com"),
    ("www.cooking.com", "www.recipes.org www.ingredients.com"),
]
WORD_LENGTHS = [("doca", "short and simple sentence"), ("docb", "another slightly longer example"), ("docc", "the final example has various word lengths")]
CHARACTERS = [("doc1", "hello world"), ("doc2", "map reduce test"), ("doc3", "character counting example")]
FOXES = [("doc1", "The quick brown fox jumps over the lazy dog"), ("doc2", "A fox is quick and brown, the dog is lazy"), ("doc3", "Every fox is different, but that one was quick")]
RINDEX = [
    ("doc101", "The quick brown fox jumps over the lazy dog"),
    ("doc102", "Brown foxes are known for their quick movements"),
    ("doc103", "Dogs and cats are common pets"),
    ("doc104", "The lazy dog sleeps all day long"),
    ("doc105", "Quick thinking saved the day"),
]

NODES = [("127.0.0.1", 10000), ("127.0.0.1", 10001), ("127.0.0.1", 10002)]
OPS = [
    (1, "put", "users", "ann", None, "one"), (2, "put", "users", "bob", None, "two"), (3, "put", "users", "ann", None, "three"), (4, "put", "files", "a.b", None, "x"),
    (5, "put", "files", ".DS_Store", None, "y"), (6, "del", "users", "bob", None, None), (7, "put", "files", "a_b", None, "z"), (8, "append", "users", "score", "points", "10"),
    (9, "append", "users", "score", "points", "20"), (10, "append", "users", "score", "name", "n"), (11, "del", "users", "nobody", None, None), (12, "put", "users", "cy", None, "four"),
]
OPS_SCHEMA = "seq bigint, op string, gid string, key string, field string, value string"
POSTINGS_OLD = [("ant", "u1", 0.5, 1), ("ant", "u2", 0.25, 1), ("bee", "u1", 0.125, 1)]
POSTINGS_NEW = [("ant", "u1", 0.75, 2), ("ant", "u3", 0.5, 2), ("cat", "u3", 1.0, 2)]
POSTINGS_SCHEMA = "term string, url string, score double, ts bigint"
CRAWLERS = [(8001, 196, 31380, 52000, 12131, 23), (8002, 196, 31086, 61000, 15009, 25), (8003, 196, 30086, 70000, 16583, 29)]
CRAWLERS_SCHEMA = "port int, pages_processed bigint, total_crawl_time bigint, bytes_downloaded bigint, terms_extracted bigint, targets_hit bigint"
HEAPS = [("n1", "crawler", 50, 100), ("n2", "crawler", 88, 100), ("n3", "indexer", 80, 100), ("n4", "indexer", 95, 100), ("n5", "indexer", 10, 0)]
HEAPS_SCHEMA = "node string, kind string, heap_used bigint, heap_total bigint"
SAMPLES = [("n1", 0, 0), ("n1", 300, 60), ("n1", 600, 150), ("n2", 0, 10), ("n2", 300, 10)]
SAMPLES_SCHEMA = "node string, at bigint, pages bigint"
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "f"), ("d", "g"), ("g", "g")]
LINKS = [("/wiki/Rose",), ("/wiki/Rose.jpg",), ("/wiki/Rose.Jpg",), ("/wiki/File:Rose",), ("/wiki/Rose#top",), ("/w/index",), (None,), ("/wiki/Fern.png",), ("/wiki/Moss",)]

SPECIES_HTML = """<html><head><title>t</title></head><body><h1>Red rose</h1>
<table class="infobox biota"><tr><th colspan="2">Rosa</th></tr><tr><td>Kingdom:</td><td> Plantae </td></tr>
<tr><td>Order:</td><td>Rosales</td></tr><tr><td>Family:</td><td>Rosaceae</td></tr></table>
<p><span class="binomial">Rosa rubra</span> is a plant in the rosaceae family. See <a href="/wiki/Fern">fern</a>.</p>
<a href="/wiki/File:Rose.jpg">image</a></body></html>"""
BIRD_HTML = '<table class="infobox biota"><tr><td>Kingdom:</td><td>Animalia</td></tr></table><span class="binomial">Avis nigra</span><a href="b.html">b</a>'
WIKI = [("https://site.org/wiki/Rose", SPECIES_HTML), ("https://site.org/wiki/Bird/index.html", BIRD_HTML), ("https://site.org/wiki/None", "<p>nothing</p>")]
SPECIES = [
    ("/wiki/Rose", "Rosa rubra", [("kingdom", "plantae"), ("order", "rosales"), ("family", "rosaceae"), ("genus", "rosa")], {"rosa": 4, "plant": 3, "rosales": 2, "family": 1}),
    ("/wiki/Fern", None, [("kingdom", "plantae"), ("class", "polypodiopsida")], {"plantae": 1, "fern": 3}),
]

#: (name, page url, page, links it has, its text): pages as they come, with what may be left out left out.
ODD_PAGES = [
    ("plain", "http://site.org/a/index.html", "<html><body><p>One <a href='q.html'>two</a></p></body></html>", ["http://site.org/a/q.html"], "One two [q.html]"),
    ("no head end", "http://site.org/a/", "<html><head><title>t</title><p>Body text here</p><p>more <A HREF=u>x</A></p></html>", ["http://site.org/a/u"], "Body text here\nmore x [u]"),
    ("many lines", "http://site.org/", '<a\nhref="n">n</a> <!-- <a href="c">c</a> --> <a data-href="d">d</a>', ["http://site.org/n"], "n [n] d"),
    ("no script", "http://site.org/", "<noscript><a href='/ns'>ns</a></noscript><script>'<a href=no>'</script><p>end", ["http://site.org/ns"], "ns [/ns]\nend"),
    ("nothing", "http://site.org/", "", [], ""),
]
#: (word, stem).
STEMMED = [("walking", "walk"), ("walked", "walk"), ("walks", "walk"), ("walker", "walker"), ("running", "run"), ("runner", "runner"), ("runs", "run"), ("ran", "ran"), ("easily", "easili"), ("fairly", "fairli")]

ARTICLES = [(1, '{"url":"u1","binomial_name":"b","article_words":["Red","rose","rose"]}'), (2, '{"type":"string","value":"{\\"url\\":\\"u2\\",\\"binomial_name\\":\\"c\\"}"}'), (3, "{}"), (4, "junk"), (5, None)]
LOCAL_LINES = [("red rose | 2 | u1",), ("bad line",), ("x | y | u",), ("moss | 10 | u2",), (" | 3 | u3",)]
BATCH_TIMES = [(n, i, (i * 7 + k) % 50) for k, n in enumerate(("n1", "n2")) for i in range(9)]
MACHINES = [("10.0.0.1", 80), ("10.0.0.1", 80), ("10.0.0.1", 81), ("10.0.0.2", 80)]
SIZES = [(12, 999), (2048, 1500), (3145728, 90000), (5368709120, 5400000)]
RAW_KEYS = [("a.b/c-d_e",), ("prefix-ab",), ("plain",)]
SEARCHES = [(1, 'The "Red Rose", of a bush!'), (2, 'no phrases'), (3, '"one" and "two three"')]
LOOSE_POSTINGS = [("a", 1, 0.5, None, 3), ("a", 2, None, 0.25, None), ("b", 1, None, None, None)]
LOOSE_SCHEMA = "term string, doc_id bigint, score double, tfidf double, count bigint"
GROUP_OPS = [(1, "put", "g", "10.0.0.1", 80), (2, "add", "g", "10.0.0.2", 80), (3, "add", "h", "10.0.0.1", 80), (4, "rem", "g", "10.0.0.1", 80), (5, "add", "g", "10.0.0.3", 81), (6, "rem", "h", "10.0.0.9", 9)]
GROUP_SCHEMA = "seq bigint, op string, gid string, ip string, port int"
GROUP_LOG = [*GROUP_OPS, (7, "del", "h", None, None), (8, "add", "h", "10.0.0.7", 7), (9, "del", "g", None, None)]
#: Links between WIKI's pages, and (url, depth, is_target, is_indexed) of a crawl that follows links of target pages only.
WIKI_EDGES = [("https://site.org/wiki/Rose", "https://site.org/wiki/Bird/index.html"), ("https://site.org/wiki/Rose", "https://site.org/wiki/None"), ("https://site.org/wiki/Bird/index.html", "https://site.org/wiki/Lost")]
WIKI_CRAWL = [("https://site.org/wiki/Rose", 0, True, True), ("https://site.org/wiki/Bird/index.html", 1, False, False), ("https://site.org/wiki/None", 1, False, False)]
#: Lines of the stemmed index of LEARNING that "deep learning" finds.
DEEP_LINES = [("deep learn | doc2 1 doc3 1",), ("deep learn power | doc2 1",), ("deep learn relat | doc3 1",), ("learn deep learn | doc3 1",)]

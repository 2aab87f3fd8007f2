"""Documents and pages that every operator must take, with extra columns of clashing names."""

DOCS = [
    (1, "The cat sat on the mat and looked at the dog by the door of the house in the rain for an hour.", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "xx", "b"),
    (5, "The cat sat on the mat and looked at the dog by the door of the house in the rain for an hour.", "en", "b"),
    (6, "word " * 60_000, "en", "a"),
    (7, "né un être à côté; ÉCOLE № 5 \U0001f600 \U0001f469‍\U0001f467", "fr", "c"), (8, "a", "de", "c"),
    (9, "line one\nline one\n\nline one\r\nx # $ | <b>", "es", "a"),
    (6, "word " * 60_000, "en", "a"), (6, "another text with the same id", "en", "a"),
    (None, "a row without an id, of some words", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot long, size long, kept boolean, fp long, bucket long, `part` long, path string"


def documents(spark, rows=DOCS):
    return spark.createDataFrame([(*r, 0, 1, 2, True, 3, 4, 5, "p") for r in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (5, 1, 0), (6, 0, 0), (9, 0, 1), (77, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


PAGES = [
    (1, "http://a.example/x/1", "<html><body><nav>menu</nav><div class='post p1'><h1>T &amp; t</h1><p>One   two<p>three <b>four</b></div><footer>f</footer></body></html>"),
    (2, "http://a.example/x/2", "<html><body><div class='post p2'><p>Other words here</div><div class='comments'><p>me too</div></body>"),
    (3, None, "<p>no url at all"), (4, "http://b.example", None), (5, "http://b.example", ""), (6, "::odd\r\nurl", "<div><p>cut <a href='x"),
    (7, "http://a.example/x/3", "<html><body><nav>menu</nav><div class='post p1'><h1>T &amp; t</h1><p>One   two<p>three <b>four</b></div><footer>f</footer></body></html>"),
    (8, "http://c.example", "x" * 300_000), (8, "http://c.example", "x" * 300_000), (None, "http://a.example", "<p>no id</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h", "t", 1) for r in rows], "page_id long, url string, html string, host string, text string, salt long")

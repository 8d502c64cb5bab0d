import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
PASSAGE = "It was the seventh crossing of the winter, and nobody on the quay believed the ferry would still be running by noon; they waited all the same."
#: Names that operators might use themselves.
CLASH = ["size", "taken", "_key", "_row", "k", "part", "node", "root", "kept", "n", "label", "spans", "target", "_text", "_source", "n_words", "ids"]

DOCS = [
    (1, "", "en", "a"), (2, None, "en", "a"), (3, "one", "en", "b"), (4, "two words", None, None), (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "a"), (7, LONG, "en", "c"), (8, LONG + "and a new end", "en", "c"),
    (9, PASSAGE + " first ending here with other words", "fr", "b"), (10, "Some other begin. " + PASSAGE, "fr", "b"), (11, PASSAGE, "fr", None),
    (12, "x " * 200, "en", "a"), (13, "é" * 300 + "日本語 " * 60, "ja", "z"), (14, "Licensed under CC BY-NC 4.0. All rights reserved. all  RIGHTS reserved", "en", "z"),
    (15, "line one is here\nline one is here\n\nother line\nline one is here " + "$ # % & word|x " * 30, "en", "z"),
    (16, "same text in two rows " * 10, "en", "a"), (16, "same text in two rows " * 10, "en", "a"), (17, "one id", "en", "a"), (17, "but two texts", "en", "b"),
    (None, "a row without an id " * 12, "en", "a"), (None, "another row without an id", None, "a"), (18, "it's they'll 'tis ''s I'm  x\n\n y　z '", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(c).alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(1, 19)] + [(None, 1, 1), (5, None, None), (999, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [
        (1, "https://EXAMPLE.org/es/x?q=1", "<p>a</p>"), (2, "http://a.example.org/en/12", "<p>a</p>"), (3, None, None), (4, "no scheme", ""), (5, "http://x.com/de/fr/", "z" * 300_000),
        (6, "http://x.com/fr/#top", "<p>a</p>"), (7, "http://org/", "é"), (8, "http://", "b"), (9, "http://a..b.net?x=http://y.com/de/", "b"), (1, "https://EXAMPLE.org/es/x?q=1", "<p>a</p>"), (None, "http://notexample.org/en/1 \r\n", "<p>a</p>"),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit(2).alias("host"), F.lit(3).alias("keeper")).repartition(2)

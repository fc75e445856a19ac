"""Small tables for the corpus operators: the usual rows, and the awkward ones."""

LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators might use for themselves.
CLASHING = "first string, key string, size string, kept string, hi string, n_links string, words string, label string, part string, node string, copies string, "
CLASHING += "c string, probability string, n_words string, word_chars string, n_symbols string, n_dup_lines string, n_repeat_words string, base_failed string, "
CLASHING += "target string, id string, pos string, digest string, class string, row string"


def awkward(spark, texts=("A plain text of a few words.",)):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing column names."""
    rows = [(1, None, "en", "a", None), (None, "No id here, but some words that are long enough to count as a line.", None, None, 3), (2, "", "en", "", 0)]
    rows += [(3, LONG, "en", "a", len(LONG)), (4, "\n \t\n", "en", "b", 4), (5, "\U0001f600 ünïcode\x0bline ", None, "b", -1)]
    rows += [(6, "Twice the same row, with a line that is long enough.", "en", "b", 52)] * 2
    rows += [(7, "Twice the same row, with a line that is long enough.", "en", None, 52)]
    rows += [(10 + k, t, "en", "c", len(t)) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHING.split(", "):
        column, kind = name.split(" ")
        frame = frame.selectExpr("*", f"cast(null as {kind}) as {column}")
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, texts, start=0, source="s"):
    return spark.createDataFrame([(start + k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCUMENTS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def page_rows():
    body = "<p>" + "x" * 200 + "</p>"
    return [
        (1, "http://a.example/x", body), (3, "http://a.example/z", body), (2, "http://a.example/y q", body), (4, None, None), (5, "", ""), (6, "http://b.example/é", "short"),
        (7, "http://b.example/t", "short"), (None, "http://n.example/", body), (8, "http://c.example/", "line\r\n\r\nWARC/1.1\r\nünïcode " + "y" * 120), (9, "http://d.example/", LONG),
        (10, "http://e.example/", "z" * 100), (11, "http://e.example/", "z" * 100), (12, "http://e.example/", "w" * 99), (13, "http://e.example/", "w" * 99),
    ]

"""Small tables that every operator has to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a repeated row, equal keys, a long text."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a", 5),
        (1, "one two three four five six", "en", "a", 5),
        (1, "another text for the same key", None, None, None),
        (None, "no key here at all", "en", "a", 1),
        (3, None, None, "b", None),
        (4, "", "fr", "b", 0),
        (5, " \t\n ", "fr", None, 4),
        (6, long, "en", "b", len(long)),
        (7, "ÉTÉ é à ß 日本 \x00 x", "fr", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)

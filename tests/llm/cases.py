"""Documents with the cases every operator must stand: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 13} line" for i in range(9000))


def hard_documents(spark, extra: str | None = None):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", None, 59),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "a row that has no id but a text of its own", "en", "a", 42),
        (None, None, None, None, None),
        (5, LONG, "de", "b", len(LONG)),
        (6, "one", "xx", "", 3),
        (6, "two words", "xx", "", 9),
        (7, "123 456 --- !!!", "en", "c", 15),
        (8, "\n\n \t\n", "fr", "c", 5),
        (9, "日本語のテキスト 🙂 ▁ naïve café", "ja", "d", 23),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in extra.split(","):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

"""Small document tables with nulls, empty and very long texts, ties and repeated rows, and a clashing extra column."""

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
EDGES = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "s", 0, None),
    (3, "  \n\t ", "en", "s", 5, None),
    (4, "The thing and the other thing went on and on.", "en", "s", 1, "y"),
    (4, "The thing and the other thing went on and on.", "en", "s", 1, "y"),
    (5, "naïve café — ÀÉ 漢字 😀\n\n<|endoftext|> it's 12,345", "fr", "s", 1, "y"),
    (None, "no id at all, but a text of words", "en", "s", 1, "y"),
    (6, "word " * 20_000 + "x" * 3000, "en", "s", 1, "y"),
]


def documents(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOC)


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

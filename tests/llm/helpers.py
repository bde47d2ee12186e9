"""Small tables that every operator is run on."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, norm string, size long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); further columns clash with names that operators use inside."""
    full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "x", "y", 7) for r in full], DOCS)


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Same text here."), (4, "Same text here."), (5, "Same  text\nhere."), (None, "Same text here."), (None, None),
    (6, "word " * 40_000), (7, "a" * 100_000), (8, "naïve café — 東京 😀 text"), (9, "\x1c\x1d odd"), (-3, "Same text here."), (10, "."),
]

"""Documents for the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, node string, size int, n int, ids string, begin long, copies string, kept string, label int, `row` int, host string, term string"


def table(spark, rows):
    """documents with extra columns whose names clash with those inside the operators. rows: doc_id, text, lang, source."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2, 3, "i", 4, "c", "k", 5, 6, "h", "t") for r in rows], DOCS)

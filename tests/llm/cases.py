"""Rows that every operator on documents has to take."""

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, part int, rest long, target double"


def docs(spark, *texts, start=0, extra=True):
    """Documents with columns that clash with names that operators use; with `extra`, awkward rows follow."""
    rows = [(start + i, t, "en", f"s{i % 3}", len(t or ""), 7, 8, 9, 10, 1.5) for i, t in enumerate(texts)]
    if extra:
        rows += awkward()
    return spark.createDataFrame(rows, DOCS_SCHEMA)


def awkward():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [(900, None), (901, ""), (902, " \t\n\x0b"), (903, "one"), (904, long), (None, "no id here at all"), (905, "same row"), (905, "same row"), (906, "É à ü ß 😀 x")]
    return [(i, t, None if i == 906 else "en", None if i in (None, 902) else "s1", None, None, 1, 2, 3, None) for i, t in texts]

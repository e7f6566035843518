"""Rows that operators must stand."""

LONG = "the cat sat on the mat and went away again " * 4000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, nid long, sig string, leaf int, tokens string, `a.b` string, __id long"
TEXTS = [
    (1, "Plain words of an ordinary text, nothing else here."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "?!... --- ***"),
    (6, LONG),
    (7, "x" * 60_000),
    (8, "Plain words of an ordinary text, nothing else here."),
    (8, "Plain words of an ordinary text, nothing else here."),
    (None, "A text without an id, of some words at least."),
    (None, None),
    (9, "word"),
    (10, "你好，世界 🎉🎉 é\u0000   ß"),
    (11, "two words"),
]


def table(spark, texts, schema=SCHEMA):
    """Documents with nulls in all other columns of every second row, and columns of clashing names."""
    rows = [
        (i, t, None, None, None, None, None, None, None, None, None, None) if k % 2 else (i, t, "en", f"s{k % 3}", len(t or ""), True, 5, "sig", 1, "tok", "x.y", 6)
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schema)

"""Awkward documents: nulls in any column, empty and long texts, repeated rows, and columns named as the operators name theirs."""

LONG = " ".join(f"word{i % 977} of many" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, "", "en", "a"), (3, None, "en", "b"), (4, " \t\n ", None, None),
    (5, "solo", "de", None), (5, "solo", "de", None), (6, "solo", "de", "b"), (None, "no id here at all", "en", "a"), (None, None, None, None),
    (7, LONG, "en", "a"), (8, "Ñandú über straße 日本語 🙂 text end", "es", "b"), (9, "x" * 5000, "en", "b"), (2, "", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row string, fp long, size long, shard int, slot int, copies int, runs string, row_key string, bits long, n long, spans string, u long, batch long, bucket long, words string, licence string, path string, file string"


def documents(spark, texts=None):
    width = len(COLUMNS.split(", "))
    rows = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in (TEXTS if texts is None else texts)]
    return spark.createDataFrame([(*r, *[None] * (width - 5)) for r in rows], COLUMNS)

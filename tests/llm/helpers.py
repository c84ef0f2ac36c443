"""Odd inputs that every operator must stand."""

LONG = "word " * 60_000
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 0),
    (4, LONG, "en", "s", 0),
    (5, "the same text of some words that is here twice and a little longer than before", "en", "s", 0),
    (5, "the same text of some words that is here twice and a little longer than before", "en", "s", 0),
    (None, "a text without an id but with a few words in it", "de", None, None),
    (7, "déjà-vu ÀÉÎ ß 漢字 мир \U0001f600 \x00 end", "fr", "s", 0),
    (8, "x" * 3000, "en", "s", 0),
    (9, "the same text of some words that is here twice and a little longer than before", "en", "s", 0),
]
#: Names that operators use inside, as columns of the input.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, k int, __text string, quality_rules string, h string, spans string, ids string, kept string, score double, component string, u int, v int, n_words int"


def odd(spark):
    rows = [(*r, 1, "fp", 2, "t", "q", "h", "s", "i", "k", 0.5, "c", 3, 4, 5) for r in ODD]
    return spark.createDataFrame(rows, CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)

"""Small tables with every odd case, shared by the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000

ODD_DOCS = [
    (1, "Some Text here, twice. " * 20, "en", "a", 10),
    (2, "some text HERE, twice. " * 20, "en", "a", None),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", "a", 300_000),
    (6, "\u00e9t\u00e9 \U0001f600 " * 30, "fr", "a", 3),
    (6, "\u00e9t\u00e9 \U0001f600 " * 30, "fr", "a", 3),
    (None, "no id at all", "en", "b", 5),
    (None, "no id at all", "en", "b", 5),
    (None, None, None, None, None),
]


def odd_docs(spark):
    """Nulls everywhere, repeated rows, ties, an empty and a long text, and clashing extra columns."""
    rows = [(*r, "x", 7, 1.5, "y") for r in ODD_DOCS]
    extra = ", kept string, copy int, rate double, node string"
    return spark.createDataFrame(rows, DOCS + extra)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def fold(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def smallest_linked(ids, links):
    """Smallest member that links reach, by following them one after the other."""
    best = {i: i for i in ids}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            best[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}

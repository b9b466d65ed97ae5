"""Token and n-gram expressions over one text column."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, bind

# What counts as an address, a handle and a token of a post.
ADDRESS = r"^\w+://"
# (The handle starts with the sign itself, so that the search can skip to it.)
HANDLE = r"@(?<![A-Za-z0-9_!@#$%&*]@)\w+"
POST_TOKEN = r"\w+://\S+|#?[\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}]"
NOT_LETTERS = r"[^\p{L}]+"


def words(text) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(as_column(text)), NOT_LETTERS), lambda t: t != "")


def post_tokens(text) -> Column:
    """Lower-case tokens of a post: handles and addresses removed, marks kept."""
    bare = F.regexp_replace(F.lower(as_column(text)), HANDLE, " ")
    found = F.regexp_extract_all(bare, F.lit(POST_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(ADDRESS))


def drop_words(tokens, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return as_column(tokens)
    return F.filter(as_column(tokens), lambda t: ~t.isin(list(stop_words)))


def ngrams(tokens, n: int) -> Column:
    """All runs of ``n`` tokens joined by a blank; empty when the text is shorter."""
    arr = as_column(tokens)
    if n == 1:
        return arr
    starts = F.when(F.size(arr) >= n, F.sequence(F.lit(1), F.size(arr) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(arr, i, n), " ")),
        F.array().cast("array<string>"),
    )


def ngram_sets(tokens, low: int, high: int) -> Column:
    """One ``(size, terms)`` struct per n-gram size from ``low`` to ``high``."""
    return bind(
        as_column(tokens),
        lambda arr: F.array(
            *[F.struct(F.lit(n).alias("size"), ngrams(arr, n).alias("terms")) for n in range(low, high + 1)]
        ),
    )


def pad_front(ids, length: int) -> Column:
    """Last ``length`` ids, zeros in front when there are fewer."""
    def pad(arr: Column) -> Column:
        kept = F.when(F.size(arr) > length, F.slice(arr, -length, length)).otherwise(arr)
        return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(arr), F.lit(0))), kept)

    return bind(as_column(ids), pad)


def wrap_back(ids, length: int, begin: int, end: int) -> Column:
    """``begin`` + first ``length - 2`` ids + ``end``, zeros behind."""
    arr = F.slice(as_column(ids), 1, length - 2)
    fill = F.array_repeat(F.lit(0), F.lit(length - 2) - F.size(arr))
    return F.concat(F.array(F.lit(begin)), arr, F.array(F.lit(end)), fill)


def mask(ids) -> Column:
    return F.transform(as_column(ids), lambda i: (i > 0).cast("int"))


def one_hot(code, size) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i == as_column(code)).cast("int"))

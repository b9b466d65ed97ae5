"""Nested posts: interactions, visible text, flat feature rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_post_time
from ..sources.schema import USER_FIELDS

# Fixed value: the link that the post format puts behind the visible text.
FINAL_LINK = r"https://t\.co/\w+$"

# Fixed value: everything that counts as a blank at the ends of a text.
BLANKS = r"[\s\x1c-\x1f]"

REPLY, QUOTE, RETWEET = "reply", "quote", "retweet"


def _is_reply() -> Column:
    return F.col("in_reply_to_status_id_str").isNotNull()


def interaction_kind() -> Column:
    """``reply``, ``quote`` or ``retweet``, in this order of precedence; else NULL."""
    return (
        F.when(_is_reply(), REPLY)
        .when(F.col("quoted_status").isNotNull(), QUOTE)
        .when(F.col("retweeted_status").isNotNull(), RETWEET)
    )


def by_kind(reply: Column, inner) -> Column:
    """A value per interaction kind; ``inner`` maps the inner post's column name."""
    return (
        F.when(_is_reply(), reply)
        .when(F.col("quoted_status").isNotNull(), inner("quoted_status"))
        .when(F.col("retweeted_status").isNotNull(), inner("retweeted_status"))
    )


def response_id() -> Column:
    """Id of the post that is replied to, quoted or reposted."""
    return by_kind(F.col("in_reply_to_status_id_str"), lambda s: F.col(f"{s}.id_str"))


def response_author() -> Column:
    return by_kind(F.col("in_reply_to_screen_name"), lambda s: F.col(f"{s}.user.screen_name"))


def is_response_to(account: str) -> Column:
    """The post replies to, quotes or reposts the account."""
    return F.coalesce(response_author() == account, F.lit(False))


def reply_scope(account: str, literal: bool = False) -> Column:
    """Replies to the account, or quotes of it.

    ``literal`` takes the author of the reposted post for quotes, which is what
    the original study's filter did.
    """
    inner = "retweeted_status" if literal else "quoted_status"
    reply = F.col("in_reply_to_status_id").isNotNull() & (F.col("in_reply_to_screen_name") == account)
    quote = F.col("is_quote_status") & (F.col(f"{inner}.user.screen_name") == account)
    return F.coalesce(reply, F.lit(False)) | F.coalesce(quote, F.lit(False))


def visible_text(post: str | None = None) -> Column:
    """The displayed part of the text without a trailing link and outer blanks.

    The range counts code points, as Spark's ``substring`` does; blanks include
    those outside ASCII.
    """
    at = (lambda n: F.col(f"{post}.{n}")) if post else F.col
    ends = at("display_text_range")
    start, stop = ends.getItem(0), ends.getItem(1)
    shown = F.substring(at("full_text"), start + 1, stop - start)
    bare = F.regexp_replace(shown, FINAL_LINK, "")
    return F.regexp_replace(F.regexp_replace(bare, rf"(?U)^{BLANKS}+", ""), rf"(?U){BLANKS}+$", "")


def flatten_posts(
    posts: DataFrame, prefix: str, score: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One flat row per post: ids, text, interaction and user fields.

    ``score`` names a ``struct<label, score>`` column to flatten as well, ``keep``
    columns to carry along.  The columns are the same for every row; fields that do not apply are NULL.
    """
    p = lambda name: f"{prefix}_{name}"
    scored = []
    if score:
        scored = [F.col(f"{score}.label").alias(p("label")), F.col(f"{score}.score").alias(p("score"))]
    none = F.lit(None).cast("string")
    return posts.select(
        *keep,
        *scored,
        F.col("id_str").alias(p("status_id")),
        F.col("user.id_str").alias(p("user_id")),
        F.col("user.screen_name").alias(p("screen_name")),
        visible_text().alias(p("display_text")),
        parse_post_time("created_at").alias(p("created_at")),
        interaction_kind().alias("interaction_type"),
        response_id().alias("interaction_status_id"),
        response_author().alias("interaction_screen_name"),
        by_kind(none, visible_text).alias("interaction_display_text"),
        parse_post_time(by_kind(none, lambda s: F.col(f"{s}.created_at"))).alias("interaction_created_at"),
        *[F.col(f"user.{f}").alias(p(f"user_{f}")) for f in USER_FIELDS],
    )


def repost_id(default: int = -1) -> Column:
    return F.coalesce(F.col("retweeted_status.id"), F.lit(default))

"""The two studies end to end: nested posts in, one flat table out."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_us, parse_post_time, seconds_to_us
from ..operators import causal, posts as op
from ..operators.explore import prefixed
from ..operators.glm import covariate_glm
from ..operators.match import asof_neighbours, join_source, keep_both_sides, near_marks, neighbour_pairs
from ..sources.sinks import checkpoint_table

ColumnScorer = Callable[[Column], Column]


def scored(posts: DataFrame, scorer: ColumnScorer) -> DataFrame:
    return posts.withColumn("sentiment", scorer(op.visible_text()))


def source_features(sources: DataFrame, scorer: ColumnScorer, path: str | None = None, overwrite: bool = False) -> DataFrame:
    """Scored, flat source posts with ``source_`` columns only."""
    flat = op.flatten_posts(scored(sources, scorer), "source", "sentiment")
    return prefixed(checkpoint_table(flat, path, overwrite) if path else flat, "source")


def reply_analysis(
    sources: DataFrame,
    responses: DataFrame,
    account: str,
    scorer: ColumnScorer,
    path: str | None = None,
    overwrite: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Replies to and quotes of the account, next to the post they answer.

    With a ``path`` the two scored tables and the result are written below it
    and reused by the next run.
    """
    at = (lambda name: f"{path.rstrip('/')}/{name}") if path else (lambda name: None)
    source = source_features(sources, scorer, at("source_scored"), overwrite)
    wanted = responses.filter(op.reply_scope(account, literal))
    flat = op.flatten_posts(scored(wanted, scorer), "response", "sentiment")
    if path:
        flat = checkpoint_table(flat, at("responses_scored"), overwrite)
    kept = flat.filter(F.col("interaction_type").isin(op.REPLY, op.QUOTE))
    joined = join_source(kept, source, "interaction_status_id", "source_status_id")
    return checkpoint_table(joined, at("responses_with_source"), overwrite) if path else joined


def before_and_after(
    sources: DataFrame,
    responses: DataFrame,
    account: str,
    scorer: ColumnScorer,
    near_seconds: float = 3600,
    band_seconds: float = 600,
    path: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Replies and quotes of users shortly before or after they met a source post.

    Every post gets its user's nearest interactions with the account on both
    sides; it is kept when one of them is nearer than ``near_seconds`` and paired
    with the source posts behind them; pairs further apart than ``band_seconds``
    are dropped.  ``is_after`` tells on which side of the source post it lies.
    """
    at = (lambda name: f"{path.rstrip('/')}/{name}") if path else (lambda name: None)
    source = source_features(sources, scorer, at("source_scored"), overwrite)
    answers = F.col("in_reply_to_status_id_str").isNotNull() | F.col("quoted_status").isNotNull()
    # Only answers reach the result; other interactions are needed as marks, so
    # their texts stay behind and everything else is dropped before the shuffle.
    texts = {c: F.when(F.col("_answers"), F.col(c)) for c in ("full_text", "text", "retweeted_status")}
    timed = (
        responses.withColumns(
            {
                "_user": F.col("user.id_str"),
                "_time": parse_post_time("created_at"),
                "_mark": F.when(op.is_response_to(account), op.response_id()),
                "_answers": answers,
            }
        )
        .filter(F.col("_time").isNotNull() & (F.col("_answers") | F.col("_mark").isNotNull()))
        .withColumns(texts)
    )
    matched = asof_neighbours(timed, "_user", "_time", F.col("_mark").isNotNull(), "_mark")
    near = near_marks(matched, "_time", near_seconds).filter("_answers")
    pairs = neighbour_pairs(near, [*responses.columns, "_time", "before_us", "after_us"])
    gap = F.abs(epoch_us("_time") - epoch_us("source_created_at"))
    joined = join_source(pairs, source, "mark_id", "source_status_id").filter(gap < seconds_to_us(band_seconds))
    # Scoring comes last, when only the rows of the result are left.
    flat = op.flatten_posts(
        scored(joined, scorer), "response", "sentiment", keep=["side", "before_us", "after_us", *source.columns]
    ).withColumn("is_after", causal.is_after("response_created_at", "source_created_at"))
    return checkpoint_table(flat, at("before_and_after"), overwrite) if path else flat


def reply_report(study: DataFrame, frequency: str = "day", min_gap_seconds: float = 0) -> dict[str, DataFrame]:
    """Score association, label model and adjusted effect of a reply study."""
    counts = ["followers_count", "friends_count", "listed_count", "statuses_count"]
    posts = study.filter(F.col("source_label").isNotNull())
    code = (F.col("source_label") != "NEGATIVE").cast("int").alias("code")
    return {
        "association": causal.score_association(
            study, "source_label", "source_score", "response_label", "response_score", test=True
        ),
        "label_model": covariate_glm(
            posts.select(code, *[F.col(f"source_user_{c}").alias(c) for c in counts]), "code", counts
        ),
        "ate": causal.binary_response_ate(
            study, "source_label", "NEGATIVE", "response_label", "NEGATIVE",
            "source_created_at", "response_created_at", min_gap_seconds, frequency, "source_status_id",
        ),
    }


def before_after_report(study: DataFrame) -> dict[str, DataFrame]:
    """Estimates on a before/after study: sizes, rates by arm and side, and the effect within users.

    ``change`` is the change of the rate behind posts labelled negative minus that
    behind the others, over all rows.  ``effect`` compares each user with
    themselves and takes those with answers on both sides of a post.
    """
    ready = study.select(
        causal.binarise("source_label").alias("x"), causal.binarise("response_label").alias("y"), "is_after",
        F.col("source_status_id").alias("post"), F.col("response_user_id").alias("usr"),
    )
    both = keep_both_sides(ready, ["usr", "post"], "is_after")
    sizes = lambda df: df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("usr").alias("n_users"), F.count_distinct("post").alias("n_posts")
    )
    arms = ready.groupBy(F.format_string("x=%d, after=%d", "x", "is_after").alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")
    )
    rate = lambda x, after: F.avg(F.when((F.col("x") == x) & (F.col("is_after") == after), F.col("y")))
    return {
        "study": sizes(ready),
        "both_sides": sizes(both),
        "arms": arms,
        "difference": ready.agg((rate(1, 1) - rate(1, 0) - rate(0, 1) + rate(0, 0)).alias("change")),
        "effect": causal.before_after_ate(both, "x", "post", "usr", "is_after", "y"),
    }


def long_report(report: dict[str, DataFrame]) -> DataFrame:
    """The parts of a report as rows ``part, term, measure, value``."""
    rows = []
    for part, frame in report.items():
        numbers = [c for c, kind in frame.dtypes if kind != "string"]
        term = F.col("term") if "term" in frame.columns else F.lit(None).cast("string")
        measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])
        rows.append(frame.select(F.lit(part).alias("part"), term.alias("term"), F.explode(measures).alias("_m")))
    long = rows[0]
    for other in rows[1:]:
        long = long.unionByName(other)
    return long.select("part", "term", "_m.measure", "_m.value")

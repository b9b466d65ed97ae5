"""Effect estimators: orders are the posts, line items the responses."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.times import gap_seconds, round_time
from ...operators import causal, glm, mixed
from ...operators.match import keep_both_sides, keep_users
from ...operators.stats import histogram
from ...sources.readers import file_versions
from .registry import Tables, p_sql, query, rounded

DAY = 86_400.0
URGENT = ["1-URGENT", "2-HIGH"]


# Bytes of response files per partition, about a million rows: what a task sorts and groups does not grow with the files.
PARTITION_BYTES = 16 * 2**20


def met(responses: DataFrame, posts: DataFrame) -> DataFrame:
    """Responses with their posts; large inputs in a number of partitions that follows the size of the files.

    Spark's own number does not follow it, and its partitions are measured as compressed.
    """
    parts = math.ceil(sum(size for _, size, _ in file_versions(responses)) / PARTITION_BYTES)
    if parts <= responses.sparkSession.sparkContext.defaultParallelism:
        return responses.join(posts, "post")
    return responses.repartition(parts, "post").join(posts.repartition(parts, "post"), "post")


def exposures(t: Tables) -> DataFrame:
    """Responses with the treatment and time of the post they belong to."""
    posts = t.orders.select(
        F.col("o_orderkey").alias("post"),
        F.col("o_orderdate").alias("post_time"),
        F.col("o_orderpriority").isin(URGENT).cast("int").alias("x"),
        F.col("o_orderpriority").alias("post_label"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.date_format(round_time("o_orderdate", "day"), "yyyy-MM-dd").alias("day"),
    )
    responses = t.lineitem.select(
        F.col("l_orderkey").alias("post"),
        F.col("l_suppkey").alias("usr"),
        F.col("l_shipdate").alias("response_time"),
        F.col("l_returnflag").alias("response_label"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return met(responses, posts)


EXPOSURES = """
exposures as (
  select o_orderkey as post, o_orderdate as post_time, cast(o_orderpriority in ('1-URGENT', '2-HIGH') as int) as x,
         o_orderpriority as post_label, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%Y-%m-%d') as day,
         l_suppkey as usr, l_shipdate as response_time, l_returnflag as response_label,
         cast(l_returnflag = 'R' as int) as y
  from lineitem join orders on l_orderkey = o_orderkey)
"""


def backdoor_sql(stratum: str, user: str | None = None, missing: str = "zero", days: int = 10, digits: int = 6) -> str:
    u, ju = (f"{user}, ", f"{user}, ") if user else ("", "")
    fill = "where m0 is not null and m1 is not null" if missing == "drop" else ""
    group = f"group by {user}" if user else ""
    return f"""
with {EXPOSURES},
kept as (select * from exposures where response_time > post_time + interval '{days}' day),
cond as (select {u}{stratum} as g, post, x, avg(y) as m from kept group by {u}{stratum}, post, x),
arms as (select {ju}g, x, sum(m) / count(*) as m, sum(m * (1 - m)) / (count(*) * count(*)) as v from cond group by {ju}g, x),
cells as (select {ju}g, max(case when x = 0 then m end) as m0, max(case when x = 1 then m end) as m1,
                 max(case when x = 0 then v end) as v0, max(case when x = 1 then v end) as v1
          from arms group by {ju}g)
select {u}round(avg(coalesce(m1, 0)) - avg(coalesce(m0, 0)), {digits}) as ate,
       round(2 * sqrt((avg(coalesce(v1, 0)) + avg(coalesce(v0, 0))) / count(*)), {digits}) as band, count(*) as n_strata
from cells {fill} {group}
"""


def ate(t: Tables, stratum: str, digits: int = 6, **options) -> DataFrame:
    return rounded(
        causal.estimate_ate(
            exposures(t), "x", "y", stratum, "post", "post_time", "response_time", 10 * DAY, **options
        ),
        digits,
    )


@query(backdoor_sql("month"))
def backdoor_ate(t):
    return ate(t, "month")


@query(backdoor_sql("day"))
def backdoor_ate_daily(t):
    return ate(t, "day")


@query(backdoor_sql("day", missing="drop"))
def backdoor_ate_overlap(t):
    return ate(t, "day", missing=causal.DROP)


# Means of a few small fractions often end in 5, so more digits are kept.
@query(backdoor_sql("month", user="usr", digits=9))
def backdoor_ate_by_user(t):
    return ate(t, "month", 9, user="usr")


@query(
    backdoor_sql("day", days=0).replace(
        "kept as (select *",
        "kept as (select * replace (cast(post_label = '1-URGENT' as int) as x, cast(response_label = 'A' as int) as y)",
    )
)
def binary_response_ate(t):
    return rounded(
        causal.binary_response_ate(
            exposures(t), "post_label", "1-URGENT", "response_label", "A",
            "post_time", "response_time", 0, "day", "post",
        )
    )


@query(f"""
with {EXPOSURES}
select month, post, x, round(avg(y), 6) as mean from exposures
where response_time > post_time + interval '10' day group by month, post, x
""")
def conditional_response(t):
    rows = exposures(t).filter(causal.far_enough("response_time", "post_time", 10 * DAY))
    return rounded(causal.conditional_response(rows, "month", "post", "x", "y"))


@query(f"""
with {EXPOSURES}
select count(*) filter (where not response_time > post_time + interval '10' day) as n_dropped,
       round(avg(cast(not response_time > post_time + interval '10' day as int)), 6) as share_dropped
from exposures
""")
def dropped_by_gap(t):
    return rounded(causal.dropped_share(exposures(t), "response_time", "post_time", 10 * DAY))


USERS = f"""
with {EXPOSURES},
users as (select usr from exposures where usr is not null group by usr
          having count(distinct x) > 1 and count(distinct post) > 1)
"""


@query(f"{USERS} select usr, count(*) as n from exposures where usr in (select usr from users) group by usr")
def exposed_users(t):
    kept = keep_users(exposures(t), "usr", "x", "post")
    return kept.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))


SIDES = f"""
with {EXPOSURES},
sided as (select *, cast(response_time > post_time as int) as is_after from exposures),
pairs as (select usr, post from sided group by usr, post having count(distinct is_after) > 1),
both_sides as (select sided.* from sided join pairs using (usr, post))
"""


def sided(t: Tables) -> DataFrame:
    return exposures(t).withColumn("is_after", causal.is_after("response_time", "post_time"))


@query(f"""{SIDES}
select usr, post, x, is_after, y, cast(epoch(response_time) as bigint) as second from both_sides
""")
def both_sides_pairs(t):
    kept = keep_both_sides(sided(t), ["usr", "post"], "is_after")
    seconds = F.unix_seconds(F.col("response_time").cast("timestamp")).alias("second")
    return kept.select("usr", "post", "x", "is_after", "y", seconds)


@query(f"""{SIDES},
users as (select x, post, usr, avg(y) filter (where is_after = 1) as a, avg(y) filter (where is_after = 0) as b
          from both_sides group by x, post, usr),
posts as (select x, post, avg(a - b) as d, sum(a * (1 - a) + b * (1 - b)) / (count(*) * count(*)) as v
          from users group by x, post),
arms as (select x, avg(d) as d, sum(v) / (count(*) * count(*)) as v from posts group by x)
select round(max(d) filter (where x = 1) - max(d) filter (where x = 0), 6) as ate, round(sum(v), 8) as variance,
       round(sqrt(sum(v)), 6) as std_error from arms
""")
def before_after_ate(t):
    # Users seen on one side only add nothing, so they need not be joined away.
    result = causal.before_after_ate(sided(t), "x", "post", "usr", "is_after", "y")
    return result.select(
        F.round("ate", 6).alias("ate"), F.round("variance", 8).alias("variance"), F.round("std_error", 6).alias("std_error")
    )


SCORES = f"""
with {EXPOSURES},
scored as (select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'NEGATIVE' else 'POSITIVE' end as sl,
                  1 / (1 + exp(2 - o_totalprice / 100000)) as ss,
                  case when l_returnflag = 'R' then 'NEGATIVE' else 'POSITIVE' end as rl,
                  (l_quantity + 1) / 52 as rs
           from lineitem join orders on l_orderkey = o_orderkey),
negative as (select case when sl = 'NEGATIVE' then ss else 1 - ss end as sp,
                    case when rl = 'NEGATIVE' then rs else 1 - rs end as rp from scored),
logits as (select ln(greatest(least(sp, 1 - 1e-9), 1e-9) / (1 - greatest(least(sp, 1 - 1e-9), 1e-9))) as a,
                  ln(greatest(least(rp, 1 - 1e-9), 1e-9) / (1 - greatest(least(rp, 1 - 1e-9), 1e-9))) as b from negative)
"""


def scored_exposures(t: Tables) -> DataFrame:
    label = lambda test: F.when(test, "NEGATIVE").otherwise("POSITIVE")
    posts = t.orders.select(
        F.col("o_orderkey").alias("post"),
        label(F.col("o_orderpriority").isin(URGENT)).alias("source_label"),
        (1 / (1 + F.exp(2 - F.col("o_totalprice") / 100_000))).alias("source_score"),
    )
    responses = t.lineitem.select(
        F.col("l_orderkey").alias("post"),
        label(F.col("l_returnflag") == "R").alias("response_label"),
        ((F.col("l_quantity") + 1) / 52).alias("response_score"),
    )
    return responses.join(posts, "post")


PAIR = ("source_label", "source_score", "response_label", "response_score")


@query(f"""{SCORES}
select round(corr(a, b), 6) as r, count(*) as n,
       round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 4) as t from logits
""")
def score_association(t):
    result = causal.score_association(scored_exposures(t), *PAIR)
    return result.select(F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"))


@query(f"""{SCORES},
s as (select corr(a, b) as r, count(*) as n, corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))) as t from logits)
select round(r, 6) as r, n, round(t, 4) as t, {p_sql('t', 'n - 2')} as p_value from s
""")
def score_association_test(t):
    result = causal.score_association(scored_exposures(t), *PAIR, test=True)
    return result.select(F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"), F.round("p_value", 6).alias("p_value"))


@query(f"""{SCORES}
select round(avg(sp), 6) as mean_source, round(avg(rp), 6) as mean_response,
       round(avg(1 / (1 + exp(-ln(greatest(least(sp, 1 - 1e-9), 1e-9) / (1 - greatest(least(sp, 1 - 1e-9), 1e-9)))))), 6) as mean_back,
       round(avg(ln(1 + sp)), 6) as mean_log1p from negative
""")
def score_transforms(t):
    from ...functions.links import clip, expit, log1p, logit

    rows = scored_exposures(t).select(
        causal.negative_score("source_label", "source_score").alias("sp"),
        causal.negative_score("response_label", "response_score").alias("rp"),
    )
    return rounded(
        rows.agg(
            F.avg("sp").alias("mean_source"),
            F.avg("rp").alias("mean_response"),
            F.avg(expit(logit(clip("sp", 1e-9)))).alias("mean_back"),
            F.avg(log1p("sp")).alias("mean_log1p"),
        )
    )


# ---- fitted models: no SQL, see the unit tests --------------------------------

@query()
def glm_probit_ate(t):
    rows = keep_users(exposures(t), "usr", "x", "post")
    return rounded(glm.glm_ate(rows, "day", "x", "y"), 4)


def hourly_cells(t: Tables) -> DataFrame:
    """Hour strata on the event timeline: purchases treat, high values answer."""
    return t.events.select(
        round_time("ts", "hour").alias("hour"),
        (F.col("event_type") == "purchase").cast("int").alias("x"),
        (F.col("value") > 50).cast("int").alias("y"),
    )


@query()
def glm_hourly_ate(t):
    return rounded(glm.glm_ate(hourly_cells(t), "hour", "x", "y"), 4)


def priority_rows(t: Tables) -> DataFrame:
    accounts = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return t.orders.join(accounts, "o_custkey").select(
        F.col("o_orderpriority").isin(URGENT).cast("int").alias("label"), "o_totalprice", "c_acctbal"
    )


@query()
def glm_covariates(t):
    return rounded(glm.covariate_glm(priority_rows(t), "label", ["o_totalprice", "c_acctbal"]), 4)


@query("""
with c as (select date_trunc('hour', ts + interval 30 minute) as hour, cast(event_type = 'purchase' as int) as x, cast(value > 50 as int) as y from events)
select strftime(hour, '%Y-%m-%d %H') as stratum, round(sum(y), 3) + 0.0 as observed, round(sum(y), 3) + 0.0 as fitted from c where y is not null group by 1
union all select null, sum(y) + 0.0, sum(y) + 0.0 from c where x = 1""")
def glm_logit_margins(t):
    """A logit fit on hour strata gives back the successes of every hour and of the treated."""
    margins = glm.glm_margins(hourly_cells(t), "hour", "x", "y")
    return rounded(margins.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")).withColumnRenamed("hour", "stratum"), 3)


@query("""
with c as (select cast(o_orderpriority in ('1-URGENT', '2-HIGH') as int) as y, cast(o_totalprice as double) as p, cast(c_acctbal as double) as b
  from orders join customer on o_custkey = c_custkey),
m as (select avg(p) as mp, stddev_samp(p) as sp, avg(b) as mb, stddev_samp(b) as sb from c)
select 'o_totalprice_norm' as term, round(sum(y * (p - mp) / sp), 3) as observed, round(sum(y * (p - mp) / sp), 3) as fitted from c, m
union all select 'c_acctbal_norm', round(sum(y * (b - mb) / sb), 3), round(sum(y * (b - mb) / sb), 3) from c, m
union all select 'intercept', sum(y) + 0.0, sum(y) + 0.0 from c""")
def glm_covariate_margins(t):
    return rounded(glm.covariate_margins(priority_rows(t), "label", ["o_totalprice", "c_acctbal"]), 3)


_fits: dict[tuple, mixed.MixedFit] = {}


def reply_model(t: Tables) -> mixed.MixedFit:
    """The fit that several queries report on; made once for a session and the files it reads."""
    key = (t.spark.sparkContext.applicationId, file_versions(t.lineitem), file_versions(t.orders))
    if key not in _fits:
        _fits[key] = fit_reply_model(t)
    return _fits[key]


def fit_reply_model(t: Tables) -> mixed.MixedFit:
    one = F.lit(1)
    return mixed.fit_mixed_model(
        exposures(t),
        "y",
        {"intercept": one, "x": F.col("x")},
        {"group": ("month", one), "user_bias": ("usr", one), "user_effect": ("usr", F.col("x"))},
    )


@query()
def mixed_model(t):
    return rounded(reply_model(t).summary(), 4)


@query()
def mixed_model_effect(t):
    fit = reply_model(t)
    return rounded(causal.average_individual_effect(fit.coefficients(), "intercept", ["x"]), 4)


@query()
def mixed_before_after(t):
    one, after = F.lit(1), F.col("is_after")
    rows = keep_both_sides(sided(t), ["usr", "post"], "is_after")
    fit = mixed.fit_mixed_model(
        rows,
        "y",
        {"intercept": one, "after": after, "x_after": F.col("x") * after},
        {
            "post": ("post", one),
            "user_baseline": ("usr", one),
            "user_bias": ("usr", after),
            "user_effect": ("usr", F.col("x") * after),
        },
    )
    return rounded(causal.difference_in_differences(fit.coefficients(), "intercept", "after", "x_after"), 4)


@query()
def random_effect_qq(t):
    fit = reply_model(t)
    return rounded(mixed.random_effect_qq(fit.effects["user_bias"], fit.sigmas["user_bias"]), 4)


@query()
def random_effect_spread(t):
    fit = reply_model(t)
    return rounded(histogram(fit.effects["user_bias"], "sd", 10), 4)


@query(f"""
with {EXPOSURES}
select usr, round(avg((epoch_us(response_time) - epoch_us(post_time)) / 1000000.0), 4) as mean_gap,
       cast(sum(cast(response_time > post_time as int)) as bigint) as n_after
from exposures group by usr
""")
def response_gaps(t):
    rows = exposures(t).withColumn("gap", gap_seconds("response_time", "post_time"))
    after = causal.is_after("response_time", "post_time")
    return rounded(rows.groupBy("usr").agg(F.avg("gap").alias("mean_gap"), F.sum(after).alias("n_after")), 4)

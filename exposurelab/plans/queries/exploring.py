"""Counts, histograms, calendars, samples and set operations."""

from pyspark.sql import functions as F

from ...functions.links import log1p
from ...functions.times import epoch_us, floor_time, round_time
from ...operators import causal, explore, stats
from .registry import Tables, p_sql, query, rounded

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def round_sql(us: str, unit: int) -> str:
    """Half-even rounding of microseconds in whole numbers."""
    rest = f"({us} % {unit})"
    whole = f"(({us} - {rest}) // {unit})"
    return f"(({whole} + case when 2 * {rest} > {unit} or (2 * {rest} = {unit} and {whole} % 2 = 1) then 1 else 0 end) * {unit})"


US = "epoch_us(ts)"
HOUR = round_sql(US, HOUR_US)


# ---- predicates and projections -----------------------------------------------------

@query("select event_id, user_id, value from events where event_type = 'purchase' and value > 100")
def string_predicate(t):
    return t.events.filter("event_type = 'purchase' and value > 100").select("event_id", "user_id", "value")


@query("""
select d.doc_id, d.lang from documents d left join labels l using (doc_id)
where l.quality is null and not starts_with(d.text, 'The')""")
def null_and_prefix(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.filter(F.col("quality").isNull() & ~F.col("text").startswith("The")).select("doc_id", "lang")


@query("""
select flag, count(*) as n from (select starts_with(text, 'RT ') or n_chars > 2000 as flag from documents) group by flag""")
def flag_repost(t):
    flagged = t.documents.withColumn("flag", explore.repost_flag("text", F.col("n_chars") > 2000))
    return explore.group_sizes(flagged, ["flag"])


@query("""
select count(*) filter (where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20') as closed,
       count(*) filter (where ts >= timestamp '2024-01-10') as open_end from events""")
def date_slice(t):
    closed = explore.date_slice(t.events, "ts", "2024-01-10", "2024-01-20").agg(F.count(F.lit(1)).alias("closed"))
    open_end = explore.date_slice(t.events, "ts", "2024-01-10").agg(F.count(F.lit(1)).alias("open_end"))
    return closed.select("closed", open_end.scalar().alias("open_end"))


@query("select event_id, event_type from events where event_type in ('signup', 'error')")
def in_set(t):
    return t.events.filter(F.col("event_type").isin("signup", "error")).select("event_id", "event_type")


@query("""
select doc_id, coalesce(marker, 'DUMMY_VALUE') as marker, coalesce(quality, 0) as quality, cast(doc_id as varchar) as id_text
from (select doc_id, quality, case when quality = 1 then lang end as marker from documents left join labels using (doc_id))""")
def fill_missing(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "quality", F.when(F.col("quality") == 1, F.col("lang")).alias("marker")
    )
    return explore.fill_missing(rows, ["marker"], ["quality"]).withColumn("id_text", F.col("doc_id").cast("string"))


@query("select event_id, value from events where round(value / 100) = 0")
def neutral_scores(t):
    return t.events.withColumn("polarity", F.round(F.col("value") / 100)).filter("polarity = 0").select("event_id", "value")


@query("select user_id as account, event_type as kind, value * 2 as doubled from events")
def rename_drop(t):
    return (
        t.events.withColumnsRenamed({"user_id": "account", "event_type": "kind"})
        .withColumns({"doubled": F.col("value") * 2})
        .drop("event_id", "ts", "value", "props")
    )


@query("""
select event_id, case when event_type = 'error' then 1 else 0 end as negative,
       case event_type when 'error' then 'bad' when 'signup' then 'good' else event_type end as relabelled from events""")
def binarise_labels(t):
    return t.events.select(
        "event_id",
        causal.binarise("event_type", "error").alias("negative"),
        F.col("event_type").alias("relabelled"),
    ).replace({"error": "bad", "signup": "good"}, subset=["relabelled"])


@query(f"""
select event_id, {HOUR} as hour_us, {round_sql(US, DAY_US)} as day_us, {US} - {US} % {DAY_US} as floor_us from events""")
def rounded_times(t):
    return t.events.select(
        "event_id",
        epoch_us(round_time("ts", "hour")).alias("hour_us"),
        epoch_us(round_time("ts", "day")).alias("day_us"),
        epoch_us(floor_time("ts", "day")).alias("floor_us"),
    )


# ---- counts -----------------------------------------------------------------------------

@query("select user_id, round(avg(value), 9) as mean from events where user_id is not null group by user_id")
def group_mean(t):
    return rounded(explore.group_mean(t.events, ["user_id"], "value"), 9)


@query("""
select event_type, count(distinct user_id) as n_users, (select count(distinct user_id) from events) as n_all
from events group by event_type""")
def distinct_counts(t):
    overall = explore.distinct_count(t.events, "user_id")
    grouped = explore.distinct_count(t.events, "user_id", ["event_type"], "n_users")
    return grouped.withColumn("n_all", overall.scalar())


@query("select count(*) as n_groups from (select user_id from events group by user_id having count(*) > 60)")
def groups_over_threshold(t):
    return explore.groups_over(t.events, ["user_id"], 60)


@query("select event_type, count(*) as n from events group by event_type")
def value_counts(t):
    return explore.value_counts(t.events, "event_type")


@query("select size, count(*) as n_groups from (select count(*) as size from events group by user_id) group by size")
def count_of_counts(t):
    return explore.count_of_counts(t.events, ["user_id"])


@query("""
with c as (select count(*) as n from lineitem group by l_orderkey)
select '(0,1]' as bin, count(*) filter (where n > 0 and n <= 1) as n from c
union all select '(1,5]', count(*) filter (where n > 1 and n <= 5) from c
union all select '(5,inf]', count(*) filter (where n > 5) from c""")
def binned_counts(t):
    return explore.binned_counts(explore.group_sizes(t.lineitem, ["l_orderkey"]), "n", [0, 1, 5])


@query("""
select count(*) filter (where n >= 4) as at_least_4, count(*) filter (where n = 7) as exactly_7
from (select count(*) as n from lineitem group by l_orderkey)""")
def threshold_count(t):
    sizes = explore.group_sizes(t.lineitem, ["l_orderkey"])
    return sizes.agg(F.count_if(F.col("n") >= 4).alias("at_least_4"), F.count_if(F.col("n") == 7).alias("exactly_7"))


@query("""
select user_id, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'view') as n_view,
       count(*) filter (where event_type = 'purchase') as n_purchase from events group by user_id""")
def pivot_counts(t):
    return explore.pivot_counts(t.events, ["user_id"], "event_type", ["click", "view", "purchase"])


@query("""
select max(n) as max_copies, (select epoch_us(min(ts)) from events) as first_us from
  (select count(*) as n from events group by event_id)""")
def id_uniqueness(t):
    first = t.events.agg(F.min(epoch_us("ts")).alias("first_us"))
    return explore.id_copies(t.events, "event_id").withColumn("first_us", first.scalar())


@query("select l_suppkey as member, count(*) as n from (select distinct l_orderkey, l_suppkey from lineitem) group by l_suppkey")
def list_member_counts(t):
    from ...sources.sinks import collect_lists

    return explore.member_counts(collect_lists(t.lineitem, "l_orderkey", "l_suppkey"), "members")


@query("select l_orderkey, count(distinct l_suppkey) as n from lineitem group by l_orderkey")
def list_lengths(t):
    from ...sources.sinks import collect_lists

    return explore.list_lengths(collect_lists(t.lineitem, "l_orderkey", "l_suppkey"), "l_orderkey", "members")


HOURLY = f"hourly as (select user_id, {HOUR} as period, count(distinct event_id) as n_posts from events group by 1, 2)"


def hourly(t: Tables):
    return explore.activity(t.events, "user_id", "ts", "event_id")


@query(f"with {HOURLY} select user_id, period as period_us, n_posts from hourly")
def hourly_activity(t):
    return hourly(t).select("user_id", epoch_us("period").alias("period_us"), "n_posts")


@query(f"with {HOURLY} select period as period_us, count(distinct user_id) as n_users from hourly group by period")
def active_users(t):
    return explore.active_users(hourly(t)).select(epoch_us("period").alias("period_us"), "n_users")


@query(f"""with {HOURLY},
grid as (select u.user_id, cast(coalesce(n_posts, 0) as double) as n from (select distinct user_id from hourly) u
         cross join (select distinct period from hourly) p left join hourly h on h.user_id = u.user_id and h.period = p.period)
select user_id, count(*) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min,
       quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as q50, quantile_cont(n, 0.75) as q75, max(n) as max
from grid group by user_id""")
def describe_user_hours(t):
    counts = hourly(t)
    periods = counts.agg(F.count_distinct("period")).scalar()
    return rounded(explore.describe_dense(counts, "user_id", periods))


@query(f"with {HOURLY} select user_id, period as period_us, round(ln(1 + n_posts), 6) as activity from hourly")
def log_activity(t):
    from ...functions.links import log1p

    return rounded(hourly(t).select("user_id", epoch_us("period").alias("period_us"), log1p("n_posts").alias("activity")))


# ---- distributions ----------------------------------------------------------------------

def histogram_sql(table: str, value: str, bins: int, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""
v as (select {b}cast({value} as double) as v from {table}),
e as (select min(v) as lo, (max(v) - min(v)) / {bins} as w from v),
h as (select {b}least(cast(floor((v - lo) / w) as bigint), {bins - 1}) as bin, lo, w, count(*) as n from v, e group by all)
"""


@query(f"with {histogram_sql('events', 'value', 20)} select bin, round(lo + bin * w, 6) as left_edge, n from h")
def histogram(t):
    return rounded(stats.histogram(t.events, "value", 20))


@query(f"""with {histogram_sql('events', 'value', 20)}
select bin, round(lo + bin * w, 6) as left_edge, n, round(n / ((select count(*) from events) * w), 8) as density from h""")
def histogram_density(t):
    h = stats.histogram(t.events, "value", 20, density=True)
    return h.select("bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 8).alias("density"))


@query(f"""with {histogram_sql('(select quality, n_chars from documents join labels using (doc_id))', 'n_chars', 15, 'quality')}
select quality, bin, round(lo + bin * w, 6) as left_edge, n,
       round(n / (sum(n) over (partition by quality) * w), 8) as density from h""")
def histogram_by_label(t):
    rows = t.documents.join(t.labels, "doc_id")
    h = stats.histogram(rows, "n_chars", 15, by=["quality"], density=True)
    return h.select("quality", "bin", F.round("left_edge", 6).alias("left_edge"), "n", F.round("density", 8).alias("density"))


def describe_sql(value: str, source: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    q = lambda p: f"round(quantile_cont(v, {p}), 6)"
    return f"""select {b}count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as min,
       {q(0.25)} as q25, {q(0.5)} as q50, {q(0.75)} as q75, max(v) as max
from (select {b}cast({value} as double) as v from {source}) {group}"""


@query(describe_sql("value", "events"))
def describe(t):
    return rounded(stats.describe(t.events, "value"))


@query(describe_sql("n_chars", "documents join labels using (doc_id)", "quality"))
def describe_by_label(t):
    return rounded(stats.describe(t.documents.join(t.labels, "doc_id"), "n_chars", ["quality"]))


@query("""
with c as (select user_id, count(*) as n_posts from events where ts >= timestamp '2024-01-10' group by user_id),
r as (select n_posts, rank() over (order by n_posts) + (count(*) over (partition by n_posts) - 1) / 2.0 as rank, count(*) over () as total from c)
select n_posts, count(*) as n, round(max(rank) / max(total), 6) as ratio from r group by n_posts""")
def activity_cdf(t):
    recent = explore.date_slice(t.events, "ts", "2024-01-10")
    counts = explore.group_sizes(recent, ["user_id"], name="n_posts")
    return rounded(stats.ecdf(counts, "n_posts")).orderBy("n_posts")


@query("""
select event_type, round(corr(value, k), 6) as r, count(*) as n,
       round(corr(value, k) * sqrt((count(*) - 2) / (1 - corr(value, k) * corr(value, k))), 4) as t
from (select event_type, value, cast(json_extract(props, '$.k') as double) as k from events) group by event_type""")
def score_pairs(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    pairs = stats.pearson(rows, "value", "k", ["event_type"])
    return pairs.select("event_type", F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"))


@query(f"""
with s as (select user_id % 50 as cohort, corr(value, k) as r, count(*) as n,
       corr(value, k) * sqrt((count(*) - 2) / (1 - corr(value, k) * corr(value, k))) as t
from (select user_id, value, cast(json_extract(props, '$.k') as double) as k from events) group by 1 having count(*) > 2)
select cohort, n, round(r, 6) as r, {p_sql('t', 'n - 2')} as p_value from s""")
def score_pairs_test(t):
    """The association by cohort of users, with its p value."""
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    cohorts = stats.pearson_test(rows.withColumn("cohort", F.col("user_id") % 50), "value", "k", ["cohort"])
    return cohorts.filter("n > 2").select("cohort", "n", F.round("r", 6).alias("r"), F.round("p_value", 6).alias("p_value"))


@query("""
with v as (select event_type, value, cast(json_extract(props, '$.k') as double) as k from events),
e as (select min(value) as lv, max(value) as hv, min(k) as lk, max(k) as hk from v)
select event_type, least(cast(floor((value - lv) * 12 / (hv - lv)) as bigint), 11) as bin_x,
       least(cast(floor((k - lk) * 12 / (hk - lk)) as bigint), 11) as bin_y, count(*) as n from v, e group by all""")
def pair_grid(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return stats.grid_counts(rows, "value", "k", 12, ["event_type"])


# ---- calendars ---------------------------------------------------------------------------

def calendar_sql(how: str, start: str, end: str) -> str:
    return f"""
with d as (select cast(ts as date) as day, {how}(value) as v from events group by 1),
s as (select {start} as a, {end} as b from d),
b as (select a, b, a - cast(dayofweek(a) as int) as sunday, b + cast(6 - dayofweek(b) as int) as stop from s),
g as (select cast(unnest(generate_series(sunday, stop, interval 1 day)) as date) as day, a, b, sunday from b)
select cast(g.day as varchar) as day, cast(floor((g.day - sunday) / 7) as bigint) as week, cast(dayofweek(g.day) as bigint) as weekday,
       round(case when g.day between a and b then coalesce(v, 0) else 0 end, 6) as value,
       case when day(g.day) = 1 then
         ['Jan.', 'Feb.', 'Mar.', 'Apr.', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(g.day)]
         || case when month(g.day) = 1 then chr(10) || year(g.day) else '' end end as tick
from g left join d on d.day = g.day"""


def as_text_day(df):
    return rounded(df.withColumn("day", F.col("day").cast("string")))


@query(calendar_sql("sum", "min(day)", "max(day)"))
def calendar_grid(t):
    return as_text_day(explore.calendar_grid(t.events, "ts", "value"))


@query(calendar_sql("avg", "date '2024-01-05'", "date '2024-02-10'").replace("as b from d)", "as b)"))
def calendar_grid_mean(t):
    return as_text_day(explore.calendar_grid(t.events, "ts", "value", "2024-01-05", "2024-02-10", mean=True))


@query(f"""
select event_type, {round_sql(US, DAY_US)} as day_us, count(value) as n, round(avg(value), 6) as mean,
       round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) as low,
       round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) as high from events group by 1, 2""")
def daily_band(t):
    band = explore.daily_band(t.events, "ts", "value", ["event_type"])
    return rounded(band.withColumn("day", epoch_us("day")).withColumnRenamed("day", "day_us"))


def bootstrap_sql(replicates: int) -> str:
    draw = "cast('0x' || substr(md5('band:' || b // 8 || ':' || event_id), 4 * (b % 8) + 1, 4) as int)"
    weight = " + ".join(f"cast(u >= {step} as int)" for step in explore.POISSON_STEPS)
    return f"""
with r as (select event_type, {round_sql(US, DAY_US)} as day_us, event_id, ln(1 + value) as value from events where value is not null),
d as (select event_type, day_us, value, b, {draw} as u from r, range({replicates}) as s(b)),
w as (select *, {weight} as w from d),
m as (select event_type, day_us, b, sum(w * value) / nullif(sum(w), 0) as m from w group by all)
select event_type, day_us, n, mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high
from m join (select event_type, day_us, count(*) as n, round(avg(value), 6) as mean from r group by all) using (event_type, day_us) group by all"""


@query(bootstrap_sql(100))
def bootstrap_band(t):
    """Bands of the logarithm: its digits never end half way, so rounding is the same everywhere."""
    band = explore.bootstrap_band(t.events.withColumn("value", log1p("value")), "ts", "value", "event_id", ["event_type"], replicates=100, seed="band")
    return rounded(band.withColumn("day", epoch_us("day")).withColumnRenamed("day", "day_us"))


# ---- profile --------------------------------------------------------------------------------

# Types of the columns of the events; numbers have moments and quartiles.
EVENT_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string",
}


def profile_sql(column: str, kind: str) -> str:
    number = kind in ("bigint", "double")
    # Minus zero is zero.
    name, column = column, f"({column} + 0::double)" if kind == "double" else column
    real = lambda e: f"round({e}, 6)" if number else "cast(null as double)"
    quartiles = ", ".join(f"{real(f'quantile_cont(cast({column} as double), {q})')} as q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    top = f"from (select cast({column} as varchar) as v, count(*) as n from events where {column} is not null group by 1) order by n desc, v limit 1"
    return f"""select '{name}' as "column", '{kind}' as type, count(*) as n_rows, count(*) - count({column}) as n_missing,
       cast(min({column}) as varchar) as smallest, cast(max({column}) as varchar) as largest,
       {real(f'avg({column})' if number else '')} as mean, {real(f'stddev_samp({column})' if number else '')} as std,
       count(distinct {column}) as n_distinct, (select v {top}) as top, (select n {top}) as top_n, {quartiles} from events"""


@query(" union all ".join(profile_sql(c, k) for c, k in EVENT_COLUMNS.items()))
def column_profile(t):
    return rounded(explore.column_profile(t.events))


@query("select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 5")
def top_values(t):
    return explore.top_values(t.events, "user_id", 5)


@query(" union all ".join(
    describe_sql("v", f"(select '{c}' as \"column\", {c} as v from lineitem)", '"column"')
    for c in ("l_quantity", "l_extendedprice", "l_discount")
))
def column_quantiles(t):
    return rounded(explore.column_quantiles(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("""
select count(*) as n_rows, cast(6 as bigint) as n_columns,
  'event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string' as columns from events""")
def shape(t):
    return explore.shape(t.events)


# ---- order, samples, sets ----------------------------------------------------------------------

@query("""
select user_id, round(mean, 9) as mean from (select user_id, avg(value) as mean from events group by user_id)
order by mean, user_id limit 10""")
def n_smallest(t):
    means = explore.group_mean(t.events, ["user_id"], "value")
    return rounded(explore.n_smallest(means, "mean", ["user_id"], 10), 9)


@query("""
(select 'first' as side, event_id, value from events order by ts, event_id limit 7)
union all (select 'last', event_id, value from events order by ts desc, event_id desc limit 7)""")
def first_last(t):
    first = explore.first_rows(t.events, ["ts", "event_id"], 7)
    last = explore.last_rows(t.events, ["ts", "event_id"], 7)
    return explore.tagged_union({"first": first, "last": last}, "side").select("side", "event_id", "value")


def draw_sql(key: str, seed: str = "") -> str:
    return f"(cast(('0x' || substr(md5('{seed}' || cast({key} as varchar)), 1, 8)) as bigint) / 4294967296.0)"


@query(f"select event_id, value from events where {draw_sql('event_id')} < 0.01")
def md5_sample(t):
    return explore.sample_fraction(t.events, "event_id", 0.01).select("event_id", "value")


@query(f"select event_id from events order by {draw_sql('event_id', 's')}, event_id limit 10")
def sample_rows(t):
    return explore.sample_rows(t.events, "event_id", 10, "s").select("event_id")


@query(f"select doc_id, quality, {draw_sql('doc_id')} < 0.25 as is_test from labels")
def train_test_split(t):
    return explore.split(t.labels, "doc_id").select("doc_id", "quality", "is_test")


@query("""
select 'orders' as origin, o_orderkey as id, o_totalprice as amount from orders
union all select 'parts', p_partkey, p_retailprice from part""")
def tagged_union(t):
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("amount"))
    return explore.tagged_union({"orders": orders, "parts": parts})


@query("select distinct l_suppkey as member from lineitem")
def list_union(t):
    from ...sources.sinks import collect_lists

    return explore.distinct_members(collect_lists(t.lineitem, "l_orderkey", "l_suppkey"), "members")


@query("""
with p as (select l_orderkey, l_partkey from lineitem),
m as (select l_partkey, count(*) > 1 as repeating from p group by l_partkey)
select l_orderkey, count(distinct l_partkey) filter (where not repeating) as n_once,
       count(distinct l_partkey) filter (where repeating) as n_repeating
from p join m using (l_partkey) group by l_orderkey""")
def once_vs_repeating(t):
    flags = explore.once_or_repeating(t.lineitem, "l_orderkey", "l_partkey")
    return explore.once_repeating_sizes(flags, "l_orderkey")


@query("select distinct c_nationkey as nation from customer except select distinct s_nationkey from supplier where s_acctbal > 8000")
def set_difference(t):
    a = t.customer.select(F.col("c_nationkey").alias("nation"))
    b = t.supplier.filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("nation"))
    return explore.set_difference(a, b, "nation")


@query("""
select c_custkey as id, c_name as name, c_mktsegment as segment, null as size from customer
union all select p_partkey, p_name, null, p_size from part""")
def tolerant_union(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return explore.tolerant_union([a, b])

"""As-of, range and lookup joins on the event timeline and on orders."""

from pyspark.sql import functions as F

from ...functions.times import epoch_us
from ...operators import match
from ...operators.stats import describe
from .effects import DAY
from .registry import query, rounded

def is_mark():
    return F.col("event_type") == "purchase"


def asof_sql(strict: bool = False) -> str:
    frame = "range between unbounded preceding and 1 preceding" if strict else "range between unbounded preceding and current row"
    return f"""
e as (select event_id, user_id, epoch_us(ts) as us, event_type = 'purchase' as is_mark from events where user_id is not null),
m as (select user_id, us, min(event_id) as id from e where is_mark group by user_id, us),
n as (select e.*, max(case when is_mark then us end) over (partition by user_id order by us {frame}) as before_us,
             min(case when is_mark then us end) over (partition by user_id order by us
                 range between 1 following and unbounded following) as after_us from e),
nearest as (select n.event_id, n.user_id, n.us, b.id as before_id, n.before_us, a.id as after_id, n.after_us
         from n left join m b on b.user_id = n.user_id and b.us = n.before_us
                left join m a on a.user_id = n.user_id and a.us = n.after_us)
"""


def asof(t, **options):
    return match.asof_neighbours(t.events, "user_id", "ts", is_mark(), "event_id", **options)


COLUMNS = ["event_id", "before_id", "before_us", "after_id", "after_us"]


@query(f"with {asof_sql()} select event_id, before_id, before_us, after_id, after_us from nearest")
def asof_before_after(t):
    return asof(t).select(COLUMNS)


@query(f"with {asof_sql(strict=True)} select event_id, before_id, before_us, after_id, after_us from nearest")
def asof_strict(t):
    return asof(t, allow_same_time=False).select(COLUMNS)


@query(f"""with {asof_sql()} select event_id, before_id, before_us, after_id, after_us from nearest
where coalesce(us - before_us < 3600000000, false) or coalesce(after_us - us < 3600000000, false)""")
def near_interactions(t):
    return match.near_marks(asof(t), "ts").select(COLUMNS)


@query(f"""with {asof_sql(strict=True)}
select event_id, 'before' as side, before_id as mark_id from nearest where before_id is not null
union all select event_id, 'after', after_id from nearest where after_id is not null""")
def neighbour_pairs(t):
    return match.neighbour_pairs(asof(t, allow_same_time=False), ["event_id"])


@query("""
with e as (select event_id, epoch_us(ts) as us, event_type = 'purchase' as is_mark from events where ts is not null),
m as (select us, min(event_id) as id from e where is_mark group by us),
n as (select e.*, max(case when is_mark then us end) over (order by us range between unbounded preceding and current row) as before_us,
             min(case when is_mark then us end) over (order by us range between 1 following and unbounded following) as after_us from e)
select n.event_id, b.id as before_id, n.before_us, a.id as after_id, n.after_us
from n left join m b on b.us = n.before_us left join m a on a.us = n.after_us""")
def asof_one_key(t):
    """All events on one time line: no task may hold the only key."""
    everyone = t.events.filter(F.col("ts").isNotNull()).withColumn("everyone", F.lit(1))
    return match.asof_neighbours(everyone, "everyone", "ts", is_mark(), "event_id").select(COLUMNS)


# ---- responses and the posts they answer ---------------------------------------

def responses(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")


def sources(t):
    return t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("""
select l_orderkey, l_linenumber, l_suppkey, l_returnflag, o_orderpriority
from lineitem join orders on l_orderkey = o_orderkey""")
def response_join(t):
    joined = match.join_source(responses(t), sources(t), "l_orderkey", "o_orderkey")
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "o_orderpriority")


@query("""
select l_orderkey, l_linenumber, l_suppkey, epoch_us(l_shipdate) - epoch_us(o_orderdate) as gap_us
from lineitem join orders on l_orderkey = o_orderkey
where abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) < 60 * 86400000000""")
def band_join(t):
    near = match.band_join(
        responses(t), sources(t), "l_orderkey", "o_orderkey", "l_shipdate", "o_orderdate", 60 * DAY
    )
    gap = (epoch_us("l_shipdate") - epoch_us("o_orderdate")).alias("gap_us")
    return near.select("l_orderkey", "l_linenumber", "l_suppkey", gap)


@query("""
select o_orderpriority, l_returnflag, count(*) as n from (
  select l_orderkey as source_id, l_returnflag from lineitem join orders on l_orderkey = o_orderkey
  where abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) < 60 * 86400000000) p
join orders on source_id = o_orderkey group by o_orderpriority, l_returnflag""")
def reattach_features(t):
    times = t.orders.select("o_orderkey", "o_orderdate")
    near = match.band_join(
        responses(t), times, "l_orderkey", "o_orderkey", "l_shipdate", "o_orderdate", 60 * DAY
    ).select(F.col("l_orderkey").alias("source_id"), "l_returnflag")
    features = t.orders.select(F.col("o_orderkey").alias("feature_id"), "o_orderpriority")
    joined = match.join_source(near, features, "source_id", "feature_id")
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# ---- ranges ----------------------------------------------------------------------

def around_marks(t):
    posts = t.events.select("event_id", "user_id", "ts", "value")
    marks = t.events.filter(is_mark()).select(
        F.col("event_id").alias("mark_id"), F.col("user_id").alias("mark_user"), F.col("ts").alias("mark_ts")
    )
    return match.range_join(posts, marks, "user_id", "mark_user", "ts", "mark_ts", 10 * 3600)


AROUND = """
around as (select p.event_id, m.event_id as mark_id, (epoch_us(p.ts) - epoch_us(m.ts)) / 1000000.0 as gap, p.user_id
           from events p join events m on p.user_id = m.user_id and m.event_type = 'purchase'
           and abs(epoch_us(p.ts) - epoch_us(m.ts)) < 36000000000)
"""


@query(f"with {AROUND} select event_id, mark_id, gap < 0 as is_before from around")
def range_join_hours(t):
    before = (epoch_us("ts") < epoch_us("mark_ts")).alias("is_before")
    return around_marks(t).select("event_id", "mark_id", before)


@query(f"""with {AROUND}
select count(*) as count, round(avg(gap), 4) as mean, round(stddev_samp(gap), 4) as std, round(min(gap), 4) as min,
       round(quantile_cont(gap, 0.25), 4) as q25, round(quantile_cont(gap, 0.5), 4) as q50,
       round(quantile_cont(gap, 0.75), 4) as q75, round(max(gap), 4) as max from (select cast(gap as double) as gap from around)""")
def gap_summary(t):
    gaps = around_marks(t).select(((epoch_us("ts") - epoch_us("mark_ts")) / 1_000_000.0).alias("gap"))
    return rounded(describe(gaps, "gap"), 4)


@query(f"with {AROUND} select user_id, count(*) as n from around group by user_id")
def around_counts(t):
    counted = match.counts_around(t.events, t.events.filter(is_mark()), "user_id", "ts", 10 * 3600)
    return counted.groupBy("user_id").agg(F.sum(F.col("n_posts") * F.col("n_marks")).alias("n")).filter("n > 0")


@query("""
select event_id, user_id from events
where abs(epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) < 36000000000""")
def around_moment(t):
    center = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return match.around(t.events, "ts", center, 10 * 3600).select("event_id", "user_id")


# ---- alignment, lookups and missing keys ---------------------------------------------

@query("select doc_id, lang, quality, toxic from documents left join labels using (doc_id)")
def left_align(t):
    return match.align_left(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("""
select nation, n_customers, n_suppliers from
  (select c_nationkey as nation, count(*) as n_customers from customer where c_acctbal > 0 group by 1)
  full join (select s_nationkey as nation, count(*) as n_suppliers from supplier where s_acctbal > 5000 group by 1) using (nation)""")
def outer_align(t):
    left = t.customer.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_customers")
    )
    right = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_suppliers")
    )
    return match.align_outer(left, right, "nation")


@query("select doc_id, quality, lang, n_chars from labels join documents using (doc_id)")
def strict_lookup(t):
    table = t.documents.select("doc_id", "lang", "n_chars")
    return match.strict_lookup(t.labels.select("doc_id", "quality"), table, "doc_id")


@query("""
select distinct l_orderkey as o_orderkey from lineitem
where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def missing_references(t):
    final = t.orders.filter("o_orderstatus <> 'P'")
    return match.missing_keys(t.lineitem, "l_orderkey", final, "o_orderkey")


@query("""
select o_orderkey, o_orderpriority, n_responders from orders join
  (select o_orderkey, count(l_orderkey) as n_responders from orders left join lineitem on l_orderkey = o_orderkey
   group by o_orderkey) using (o_orderkey) where n_responders = 0""")
def posts_without_responders(t):
    posts = t.orders.select("o_orderkey", "o_orderpriority")
    counted = match.with_reference_count(posts, "o_orderkey", t.lineitem, "l_orderkey", "n_responders")
    return counted.filter("n_responders = 0")


@query("""
select count(*) filter (where n = 0) as without, count(*) filter (where n > 0) as having_some, max(n) as most
from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)""")
def responder_totals(t):
    counted = match.with_reference_count(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey", "n")
    return counted.agg(
        F.count_if(F.col("n") == 0).alias("without"),
        F.count_if(F.col("n") > 0).alias("having_some"),
        F.max("n").alias("most"),
    )


@query("""
select distinct user_id, epoch_us(ts) as us, event_id from events where event_type = 'purchase'""")
def interactions_by_user(t):
    marks = match.distinct_marks(t.events.filter(is_mark()), "user_id", "ts", "event_id")
    return marks.select("user_id", epoch_us("ts").alias("us"), "event_id")

"""Sources and sinks: written to the shared folder and read back."""

from pyspark.sql import functions as F

from ...functions.times import epoch_us
from ...operators import explore
from ...session import scratch_path
from ...sources import readers, sinks
from .registry import query, rounded


@query("select event_id, epoch_us(ts) as us, user_id, value from events")
def write_json(t):
    """Dates keep their type and their microseconds."""
    path = scratch_path(t.spark, "events")
    sinks.write_json(t.events.select("event_id", "ts", "user_id", "value"), path)
    back = readers.read_posts(
        t.spark, path, "event_id bigint, ts timestamp_ntz, user_id bigint, value double", pattern="*.json"
    )
    return back.select("event_id", epoch_us("ts").alias("us"), "user_id", "value")


@query("select doc_id, lang, n_chars, length(text) as n from documents")
def whole_file_frame(t):
    path = scratch_path(t.spark, "documents")
    sinks.write_json(t.documents, path)
    back = t.spark.read.schema(t.documents.schema).json(path)
    return back.select("doc_id", "lang", "n_chars", F.length("text").cast("long").alias("n"))


@query("""
select cast(l_orderkey as varchar) as post_id, count(distinct l_suppkey) as n_users,
       min(l_suppkey) as first_user, max(l_suppkey) as last_user from lineitem group by l_orderkey""")
def write_map(t):
    path = scratch_path(t.spark, "map")
    sinks.write_map(t.lineitem, "l_orderkey", "l_suppkey", path)
    lists = readers.read_map(t.spark, path)
    return (
        lists.select("post_id", F.explode("users").alias("user"))
        .groupBy("post_id")
        .agg(F.count("user").alias("n_users"), F.min("user").alias("first_user"), F.max("user").alias("last_user"))
    )


@query("""
select s_nationkey as nation, count(*) as n_lists, sum(n)::bigint as n_users from
  (select s_nationkey, count(distinct l_orderkey) as n from lineitem join supplier on l_suppkey = s_suppkey group by all)
group by s_nationkey""")
def map_document(t):
    """The lists come in parts; a reader adds them up."""
    path = scratch_path(t.spark, "map")
    nations = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = t.lineitem.select("l_orderkey", "l_suppkey").join(nations, "l_suppkey")
    sinks.write_map(rows, "s_nationkey", "l_orderkey", path, parts=4)
    sizes = explore.list_lengths(readers.read_map(t.spark, path), "post_id", "users")
    return sizes.groupBy(F.col("post_id").cast("int").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_lists"), F.sum("n").alias("n_users")
    )


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def checkpoint_manifest(t):
    """The second call finds the table of the same plan and reads it."""
    path = scratch_path(t.spark, "checkpoint")
    sums = lambda: t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    sinks.checkpoint_table(sums(), path)
    return rounded(sinks.checkpoint_table(sums(), path), 4)


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def checkpoint_reload(t):
    """The second call reads what the first one wrote."""
    path = scratch_path(t.spark, "checkpoint")
    sums = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    sinks.materialize(sums, path)
    return rounded(sinks.materialize(sums.limit(0), path), 4)


@query("select p_partkey, p_name, p_type, p_size, round(p_retailprice, 2) as p_retailprice from part")
def csv_roundtrip(t):
    path = scratch_path(t.spark, "parts")
    columns = t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    sinks.write_csv(columns, path)
    return rounded(readers.read_csv(t.spark, path, columns.schema), 2)


@query("""
with parts as (select distinct event_id % 8 as part from events),
drawn as (select part from parts order by md5('part=' || part) limit 3)
select event_type, count(*) as n from events where event_id % 8 in (select part from drawn) group by event_type""")
def file_sample(t):
    """Three of eight folders with a file each, drawn by their names."""
    path = scratch_path(t.spark, "parts")
    rows = t.events.withColumn("part", F.col("event_id") % 8)
    rows.repartition(8, "part").write.partitionBy("part").parquet(path)
    sampled = readers.sample_files(t.spark.read.parquet(path), 3, name=lambda file: file.split("/")[-2])
    return sampled.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select 'documents' as entity, doc_id from documents")
def entity_files(t):
    """Files are entities here: one of the wanted two exists."""
    both = t.spark.read.schema("doc_id bigint").parquet(t.path("documents"), t.path("labels"))
    wanted = t.spark.range(1).select(F.explode(F.array(F.lit("documents"), F.lit("absent"))).alias("name"))
    return readers.read_entities(both, wanted).select("entity", "doc_id")


@query("select event_type, count(*) as n from events group by event_type")
def repartitioned(t):
    many = t.events.repartition(16)
    return explore.group_sizes(many.coalesce(4), ["event_type"])


@query("""
select distinct cast(l_suppkey as varchar) as member from lineitem
where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)""")
def fetch_backlog(t):
    lists = sinks.collect_lists(t.lineitem, "l_orderkey", "l_suppkey")
    landed = t.supplier.filter("s_acctbal > 0")
    return readers.fetch_backlog(lists, "members", landed, "s_suppkey")


@query("""
with b as (select distinct o_custkey as id, cast(('0x' || substr(md5(cast(o_custkey as varchar)), 1, 8)) as bigint) % 64 as bucket from orders),
n as (select *, (row_number() over (partition by bucket order by id) - 1) // 100 as batch from b)
select bucket, batch, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as ids from n group by bucket, batch""")
def lookup_batches(t):
    batches = readers.lookup_batches(t.orders, "o_custkey")
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")
    return batches.select("bucket", "batch", F.size("ids").cast("long").alias("n"), text)

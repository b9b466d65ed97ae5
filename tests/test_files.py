import json

import pytest
from pyspark.sql import functions as F

from exposurelab import session
from exposurelab.sources import readers, sinks


def test_materialize_reuses_only_finished_output(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.materialize(spark.range(3), path)
    assert sinks.materialize(spark.range(99), path).count() == 3
    assert sinks.materialize(spark.range(5), path, overwrite=True).count() == 5
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert sinks.materialize(spark.range(7), path).count() == 7


def test_map_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1": [5, 6], "2": [], "3": [5]}, indent=1))
    lists = readers.read_map_document(spark, str(tmp_path))
    assert {r["post_id"]: r["users"] for r in lists.collect()} == {"1": [5, 6], "2": [], "3": [5]}


def test_long_lists_come_in_parts(spark, tmp_path):
    pairs = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 1), (2, 1), (3, None)], "k int, m int")
    sinks.write_map(pairs, "k", "m", str(tmp_path / "map"), parts=8)
    lists = readers.read_map(spark, str(tmp_path / "map")).collect()
    members = sorted(u for r in lists if r["post_id"] == "1" for u in r["users"])
    assert members == list(range(100)) and sum(r["post_id"] == "1" for r in lists) > 4
    assert [r["users"] for r in lists if r["post_id"] == "2"] == [[1]]


def test_entity_files_and_backlog(spark, tmp_path):
    for name in ("11", "12", "13"):
        (tmp_path / f"{name}.ndjson").write_text(json.dumps({"id": int(name) * 10}) + "\n")
    posts = readers.read_posts(spark, str(tmp_path), "id bigint")
    wanted = spark.createDataFrame([(11,), (13,), (99,)], "user int")
    got = {(r["entity"], r["id"]) for r in readers.read_entities(posts, wanted).collect()}
    assert got == {("11", 110), ("13", 130)}
    landed = readers.landed_entities(spark, str(tmp_path))
    assert {r["entity"] for r in landed.collect()} == {"11", "12", "13"}
    lists = spark.createDataFrame([("a", [11, 20]), ("b", [20, 30])], "k string, users array<int>")
    backlog = readers.fetch_backlog(lists, "users", landed, "entity")
    assert {r["member"] for r in backlog.collect()} == {"20", "30"}
    sampled = readers.sample_files(posts, 2)
    assert sampled.count() == 2 and readers.sample_files(posts, 2).count() == 2


def test_one_layout_for_every_size(spark):
    """The rows of a key depend on the number of parts alone."""
    for n in (1, 50, 5000):
        pairs = spark.range(n).selectExpr("1 as k", "id as m")
        assert [len(r["members"]) for r in sinks.collect_lists(pairs, "k", "m").collect()] == [n]
    buckets = {}
    for n in (100, 1000):
        rows = readers.lookup_batches(spark.range(n), "id", size=10).collect()
        for r in rows:
            for i in r["ids"]:
                assert buckets.setdefault(i, r["bucket"]) == r["bucket"]


def test_sampled_files_do_not_depend_on_the_write(spark, tmp_path):
    drawn = []
    for name in ("a", "b"):
        spark.range(800).repartition(8, "id").write.parquet(str(tmp_path / name))
        rows = readers.sample_files(spark.read.parquet(str(tmp_path / name)), 3).collect()
        drawn.append(sorted(r["id"] for r in rows))
    assert drawn[0] == drawn[1] and 0 < len(drawn[0]) < 800


def test_batches_hold_every_id_once(spark):
    ids = spark.range(1000).union(spark.range(10))
    rows = readers.lookup_batches(ids, "id", size=100, buckets=4).collect()
    assert all(0 < len(r["ids"]) <= 100 for r in rows)
    assert sorted(i for r in rows for i in r["ids"]) == list(range(1000))


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    rows = [(1, 'say "hi", then\ngo'), (2, None), (3, "plain")]
    df = spark.createDataFrame(rows, "id int, text string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    (tmp_path / "d.csv").write_text("id,text\n1,a\rb\n2,c\n")
    plain = readers.read_csv(spark, str(tmp_path / "d.csv"), "id int, text string")
    assert plain.count() == 2


def test_json_keeps_microseconds(spark, tmp_path):
    df = spark.range(1).select(F.timestamp_micros(F.lit(1577836800123456)).alias("t"))
    sinks.write_json(df, str(tmp_path / "j"))
    back = readers.read_posts(spark, str(tmp_path / "j"), "t timestamp", pattern="*.json")
    assert back.select(F.unix_micros("t")).first()[0] == 1577836800123456


def test_declared_subset_prunes_the_scan(spark, tmp_path):
    (tmp_path / "p.ndjson").write_text(json.dumps({"id": 1, "created_at": "x", "full_text": "long"}) + "\n")
    df = readers.read_posts(spark, str(tmp_path), "id bigint, created_at string").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert readers.spread(wide) is wide
    assert readers.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 8


def test_cut_lineage_and_scratch_stay_in_the_shared_folder(spark):
    df = session.cut_lineage(spark.range(4))
    assert df.count() == 4
    assert session.scratch_path(spark, "x").startswith(session.shared_dir(spark))
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_cluster_sessions_must_name_the_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_no_list_grows_with_the_data(spark):
    pairs = spark.range(30_000).selectExpr("id % 2 * (id % 100) as k", "id as m")
    lists = sinks.collect_lists(pairs.union(pairs), "k", "m", size=500).collect()
    assert max(len(r["members"]) for r in lists) <= 500
    assert sum(r["k"] == 0 for r in lists) == 60 and all(sum(r["k"] == k for r in lists) == 1 for k in (1, 99))
    assert sorted(m for r in lists for m in r["members"]) == list(range(30_000))
    assert len(sinks.collect_lists(spark.range(20_001).selectExpr("1 as k", "id as m"), "k", "m").collect()) == 5


def test_checkpoint_with_manifest(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "table")
    spark.range(10).write.parquet(source)
    plan = lambda least=3: spark.read.parquet(source).filter(F.col("id") > least)
    assert sinks.checkpoint_table(plan(), path).count() == 6
    written = sinks.read_manifest(spark, path)
    assert written["plan"] == sinks.plan_digest(plan()) and written["schema"]["fields"][0]["name"] == "id"
    # Equal: reused, although the expressions have other numbers.
    stamp = [p.stat().st_mtime_ns for p in sorted((tmp_path / "table").glob("part-*"))]
    assert sinks.checkpoint_table(plan(), path).count() == 6
    assert stamp == [p.stat().st_mtime_ns for p in sorted((tmp_path / "table").glob("part-*"))]
    # Another constant, another schema, other input.
    with pytest.raises(ValueError, match="another plan"):
        sinks.checkpoint_table(plan(4), path)
    with pytest.raises(ValueError, match="another schema, plan"):
        sinks.checkpoint_table(plan().withColumn("x", F.lit(1)), path)
    spark.range(20).write.mode("overwrite").parquet(source)
    with pytest.raises(ValueError, match="another plan"):
        sinks.checkpoint_table(plan(), path)
    assert sinks.checkpoint_table(plan(), path, overwrite=True).count() == 16
    # Broken off: written again.  Foreign: left alone.
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert sinks.checkpoint_table(plan(5), path).count() == 14
    foreign = str(tmp_path / "foreign")
    spark.range(2).write.parquet(foreign)
    with pytest.raises(ValueError, match="no manifest"):
        sinks.checkpoint_table(plan(), foreign)
    assert spark.read.parquet(foreign).count() == 2


def test_manifest_sees_every_column_of_a_wide_plan(spark):
    wide = lambda last: spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(60)], F.lit(last).alias("z"))
    assert sinks.plan_digest(wide(1)) == sinks.plan_digest(wide(1))
    assert sinks.plan_digest(wide(1)) != sinks.plan_digest(wide(2))

import random

import pytest
from pyspark.sql import functions as F

from exposurelab.operators import match, scan, skew


@pytest.fixture(scope="module")
def timeline(spark):
    """One user holds most rows; times repeat, some rows are marks."""
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 9), rng.randint(0, 300), rng.random() < 0.2) for i in range(800)]
    rows += [(801, None, 5, True), (802, 10, 7, False), (803, 11, 7, True)]
    df = spark.createDataFrame(rows, "id int, usr int, second int, mark boolean")
    return rows, df.withColumn("ts", F.timestamp_seconds(F.col("second"))).repartition(7).cache()


def brute(rows, same_time=True):
    out = {}
    for i, u, s, _ in rows:
        if u is None:
            continue
        marks = [(t, j) for j, v, t, m in rows if m and v == u]
        before = [(t, -j) for t, j in marks if (t <= s if same_time else t < s)]
        after = [(t, j) for t, j in marks if t > s]
        b = max(before, default=None)
        a = min(after, default=None)
        out[i] = (b and -b[1], b and b[0] * 10**6, a and a[1], a and a[0] * 10**6)
    return out


@pytest.mark.parametrize("same_time", [True, False])
@pytest.mark.parametrize("seconds", [86_400, 7, 1])
def test_asof_equals_brute_force_however_time_is_cut(timeline, same_time, seconds):
    rows, df = timeline
    got = match.asof_neighbours(df, "usr", "ts", F.col("mark"), "id", same_time, seconds).collect()
    assert {r["id"]: (r["before_id"], r["before_us"], r["after_id"], r["after_us"]) for r in got} == brute(rows, same_time)


def test_rows_and_marks_without_a_time(spark):
    rows = [(1, 1, None, True), (2, 1, 5, False), (3, 1, 3, True), (4, 1, None, False)]
    df = spark.createDataFrame(rows, "id int, usr int, second int, mark boolean").withColumn("ts", F.timestamp_seconds("second"))
    got = {r["id"]: (r["before_id"], r["after_id"]) for r in match.asof_neighbours(df, "usr", "ts", F.col("mark"), "id").collect()}
    assert got == {1: (None, None), 2: (3, None), 3: (3, None), 4: (None, None)}


def test_nothing_runs_while_a_scan_is_planned(timeline, monkeypatch):
    """No job before the first action, and a hot user's rows lie in many segments."""
    _, df = timeline
    tracker, group = df.sparkSession.sparkContext.statusTracker(), "scan-plan"
    df.sparkSession.sparkContext.setJobGroup(group, group)
    made = match.asof_neighbours(df, "usr", "ts", F.col("mark"), "id", True, 7)
    counted = match.counts_around(df, df.filter("mark"), "usr", "ts", 13, 7)
    batches = scan.numbered(df, ["usr"], "id", scan.step_segment(F.col("id"), 50), "n")
    assert list(tracker.getJobIdsForGroup(group)) == []
    assert made.count() == 802 and counted.count() > 0
    numbers = {r["id"]: r["n"] for r in batches.collect()}
    assert len(tracker.getJobIdsForGroup(group)) > 0
    df.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    per_user = {}
    for r in df.orderBy("id").collect():
        per_user[r["usr"]] = per_user.get(r["usr"], 0) + 1
        assert numbers[r["id"]] == per_user[r["usr"]]


@pytest.mark.parametrize("resolution", [1, 4096])
def test_value_segments_follow_the_order(spark, resolution):
    rng = random.Random(2)
    values = sorted({rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 18) for _ in range(3000)} | {0.0, -0.0, 1e300})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1)
    found = [r["s"] for r in rows.orderBy("i").select(scan.value_segment(F.col("v"), resolution).alias("s")).collect()]
    assert found == sorted(found)


@pytest.mark.parametrize("step", [None, 3, 1000])
def test_running_weight_with_null_keys(spark, step):
    segment = None if step is None else scan.step_segment(F.col("v"), step)
    rng = random.Random(3)
    weights = {(rng.choice([None, 1, 2]), v): rng.randrange(1, 5) for v in range(-60, 60) for _ in range(2)}
    df = spark.createDataFrame([(k, v, n) for (k, v), n in weights.items()], "k int, v int, n int").repartition(5)
    for r in scan.running_weight(df, ["k"], "v", "n", segment).collect():
        mine = {v: n for (k, v), n in weights.items() if k == r["k"]}
        assert r["running"] == sum(n for v, n in mine.items() if v <= r["v"])
        assert r["total"] == sum(mine.values()) and r["total_sum"] == sum(v * n for v, n in mine.items())


def test_near_marks_excludes_the_limit_itself(spark):
    rows = [(1, 1, 0, True), (2, 1, 3600, False), (3, 1, 3599, False), (4, 2, 0, False), (5, 2, 100, True)]
    df = spark.createDataFrame(rows, "id int, usr int, second int, mark boolean").withColumn(
        "ts", F.timestamp_seconds("second")
    )
    matched = match.asof_neighbours(df, "usr", "ts", F.col("mark"), "id", allow_same_time=False)
    assert {r["id"] for r in match.near_marks(matched, "ts").collect()} == {3, 4}
    pairs = match.neighbour_pairs(matched, ["id"]).collect()
    assert {(r["id"], r["side"], r["mark_id"]) for r in pairs} == {(2, "before", 1), (3, "before", 1), (4, "after", 5)}


def test_range_join_equals_theta_join(timeline):
    rows, df = timeline
    marks = df.filter("mark").select(
        F.col("id").alias("mark_id"), F.col("usr").alias("mark_usr"), F.col("ts").alias("mark_ts")
    )
    got = match.range_join(df, marks, "usr", "mark_usr", "ts", "mark_ts", 13).select("id", "mark_id").collect()
    expected = [
        (i, j) for i, u, s, _ in rows for j, v, t, m in rows if m and u is not None and u == v and abs(s - t) < 13
    ]
    assert sorted((r["id"], r["mark_id"]) for r in got) == sorted(expected)


@pytest.mark.parametrize("segment_seconds", [86_400, 5])
def test_counts_around_equal_counted_pairs(timeline, segment_seconds):
    rows, df = timeline
    counted = match.counts_around(df, df.filter("mark"), "usr", "ts", 13, segment_seconds).collect()
    got = {(r["usr"], r["us"] // 10**6): (r["n_posts"], r["n_marks"]) for r in counted}
    expected = {}
    for _, u, s, _ in rows:
        if u is not None:
            marks = sum(m and v == u and abs(s - t) < 13 for _, v, t, m in rows)
            expected[u, s] = (expected.get((u, s), (0, 0))[0] + 1, marks)
    assert got == expected


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_takes_both_paths(spark, how):
    left = spark.createDataFrame([(i, "the" if i % 3 else f"w{i % 7}") for i in range(90)], "id int, token string")
    table = spark.createDataFrame([("the", 1), ("w0", 2), ("zzz", 3)], "token string, v int")
    sent = skew.lookup_join(left, table, "token", "id", how)
    salted = skew.lookup_join(left, table, "token", "id", how, broadcast_rows=2)
    assert sorted(map(repr, sent.collect())) == sorted(map(repr, salted.collect()))


def test_keep_users_and_sides(spark):
    rows = [("hot", x % 2, x % 5) for x in range(60)] + [("one_label", 1, 1), ("one_label", 1, 2), ("one_post", 0, 1), ("one_post", 1, 1), (None, 0, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "usr string, x int, post int")
    kept = match.keep_users(df, "usr", "x", "post")
    assert {r["usr"]: r["n"] for r in kept.groupBy("usr").agg(F.count("*").alias("n")).collect()} == {"hot": 60}
    sides = match.keep_both_sides(df, ["usr", "post"], "x")
    assert {(r["usr"], r["post"]) for r in sides.collect()} == {("hot", p) for p in range(5)} | {("one_post", 1)}


def test_joins_refuse_shared_names_and_missing_keys(spark):
    a = spark.createDataFrame([(1, 2)], "id int, v int")
    with pytest.raises(ValueError):
        match.join_source(a, a, "id", "id")
    strict = match.strict_lookup(a, spark.createDataFrame([(2, 2)], "id int, w int"), "id")
    for run in (strict.collect, strict.count, strict.select("v").collect):
        with pytest.raises(Exception, match="no match for id 1"):
            run()
    assert match.strict_lookup(a, spark.createDataFrame([(1, 2), (3, 2)], "id int, w int"), "id").collect() == [(1, 2, 2)]
    assert match.missing_keys(a, "id", spark.createDataFrame([(2,)], "k int"), "k").collect()[0]["k"] == 1


def test_reference_counts(spark):
    posts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    refs = spark.createDataFrame([(1,), (1,), (3,), (None,)], "post int")
    got = match.with_reference_count(posts, "id", refs, "post", "n").collect()
    assert {r["id"]: r["n"] for r in got} == {1: 2, 2: 0, 3: 1}

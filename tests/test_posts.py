import json

import pytest
from pyspark.sql import functions as F

from exposurelab.functions.times import parse_post_time
from exposurelab.operators import posts as op
from exposurelab.operators.scorer import keyword_scorer
from exposurelab.operators.text import score_text

from .scorers import KeywordScorer
from exposurelab.plans import studies
from exposurelab.sources.readers import read_posts

ACCOUNT = "source_account"


def user(i, name):
    return {
        "id": i, "id_str": str(i), "screen_name": name, "followers_count": i, "friends_count": 2, "listed_count": 3,
        "created_at": "Wed Oct 10 20:19:24 +0000 2018", "statuses_count": 4, "location": "here",
    }


def post(i, text, who, minute=0, reply=None, quoted=None, reposted=None, span=None):
    when = f"Wed Oct 10 {20 + minute // 60:02d}:{minute % 60:02d}:00 +0000 2018" if minute is not None else None
    made = {
        "id": i, "id_str": str(i), "created_at": when, "full_text": text, "text": text, "truncated": False,
        "display_text_range": span or [0, len(text)], "lang": "en", "source": "web", "is_quote_status": quoted is not None,
        "in_reply_to_status_id": reply and reply[0], "in_reply_to_status_id_str": reply and str(reply[0]),
        "in_reply_to_screen_name": reply and reply[1], "user": user(*who),
    }
    if quoted:
        made["quoted_status"] = quoted
    if reposted:
        made["retweeted_status"] = reposted
    return made


ME, OTHER, ANN, BOB = (1, ACCOUNT), (2, "other"), (10, "ann"), (11, "bob")
FIRST = post(100, "bad bad news https://t.co/abc", ME, 0)
SECOND = post(101, "good news", ME, 30)
FOREIGN = post(102, "good", OTHER, 0)
POSTS = [
    post(1, "plain", ANN, 1),
    post(2, "@x so bad", ANN, 5, reply=(100, ACCOUNT)),
    post(3, "reply elsewhere", BOB, 6, reply=(102, "other")),
    post(4, "good quote", BOB, 7, quoted=FIRST),
    post(5, "RT", BOB, 8, reposted=SECOND),
    post(6, "repost of a quote", BOB, 40, quoted=SECOND, reposted=FIRST),
    post(7, "bad reply that quotes", ANN, 9, reply=(101, ACCOUNT), quoted=FOREIGN),
    post(8, "\U0001F600 smile https://t.co/x1", ANN, 10, span=[0, 7]),
    post(9, "   spaced 　 https://t.co/zz", ANN, 11),
    post(10, "https://t.co/only", ANN, 12),
    post(11, "no date", ANN, None),
]


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("posts")
    (folder / "a.ndjson").write_text("\n".join(json.dumps(p) for p in POSTS[:6]) + "\n")
    (folder / "b.ndjson").write_text("\n".join(json.dumps(p) for p in POSTS[6:]) + "\n")
    (folder / "ignored.txt").write_text("not json")
    return read_posts(spark, str(folder))


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    (folder / "s.ndjson").write_text("\n".join(json.dumps(p) for p in (FIRST, SECOND)))
    return read_posts(spark, str(folder))


def by_id(df, column):
    return {r["id"]: r["r"] for r in df.select("id", column.alias("r")).collect()}


def test_precedence_is_reply_quote_retweet(posts):
    kinds = by_id(posts, op.interaction_kind())
    assert {i: k for i, k in kinds.items() if k} == {2: "reply", 3: "reply", 4: "quote", 5: "retweet", 6: "quote", 7: "reply"}
    targets = by_id(posts, op.response_id())
    assert (targets[2], targets[4], targets[5], targets[6], targets[7], targets[1]) == ("100", "100", "101", "101", "101", None)


def test_one_account_for_all_kinds(posts):
    flags = by_id(posts, op.is_response_to(ACCOUNT))
    assert {i for i, f in flags.items() if f} == {2, 4, 5, 6, 7} and None not in flags.values()


def test_reply_scope_and_its_literal_form(posts):
    scope = lambda **o: {r["id"] for r in posts.filter(op.reply_scope(ACCOUNT, **o)).collect()}
    assert scope() == {2, 4, 6, 7}
    assert scope(literal=True) == {2, 6, 7}


def test_visible_text(posts):
    texts = by_id(posts, op.visible_text())
    assert texts[8] == "\U0001F600 smile"
    assert texts[9] == "spaced" and texts[10] == "" and texts[1] == "plain"
    inner = by_id(posts, op.visible_text("quoted_status"))
    assert inner[4] == "bad bad news" and inner[1] is None


def test_flatten(posts):
    row = op.flatten_posts(posts, "response").filter("response_status_id = '4'").first().asDict()
    assert row["interaction_type"] == "quote" and row["interaction_screen_name"] == ACCOUNT
    assert row["interaction_display_text"] == "bad bad news" and row["interaction_created_at"] is not None
    assert row["response_user_screen_name"] == "bob" and row["response_user_followers_count"] == 11
    missing = op.flatten_posts(posts, "p").filter("p_status_id = '11'").first()
    assert missing["p_created_at"] is None
    assert by_id(posts, op.repost_id())[5] == 101 and by_id(posts, op.repost_id())[1] == -1


def scorer(text):
    return score_text(text, KeywordScorer(["bad"], ["good"]))


def test_scorer_and_null_text(spark):
    df = spark.createDataFrame([(1, "bad bad good"), (2, "good"), (3, None)], "id int, t string")
    got = by_id(df, scorer("t"))
    assert (got[1]["label"], got[1]["score"]) == ("NEGATIVE", pytest.approx(3 / 5))
    assert (got[2]["label"], got[2]["score"]) == ("POSITIVE", pytest.approx(2 / 3))
    assert got[3]["label"] == "POSITIVE"


def test_keyword_scorer_needs_no_python(spark):
    rows = [(1, "bad bad good"), (2, "good"), (3, None), (4, ""), (5, "Bad-good, BAD!"), (6, "none")]
    df = spark.createDataFrame(rows, "id int, t string")
    made = df.withColumn("s", keyword_scorer(["bad"], ["good"])("t"))
    assert by_id(df, scorer("t")) == {r["id"]: r["s"] for r in made.collect()}
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_filter_passes_below_the_scorer(posts):
    plan = (
        posts.withColumn("s", scorer(op.visible_text())).filter("lang = 'en'")._jdf.queryExecution().optimizedPlan().toString()
    )
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_reply_analysis(posts, sources, tmp_path):
    run = lambda **o: studies.reply_analysis(sources, posts, ACCOUNT, scorer, path=str(tmp_path / "run"), **o)
    rows = {r["response_status_id"]: r for r in run().collect()}
    assert set(rows) == {"2", "4", "6", "7"}
    assert rows["2"]["source_label"] == "NEGATIVE" and rows["7"]["source_label"] == "POSITIVE"
    assert rows["2"]["response_label"] == "NEGATIVE" and rows["4"]["response_label"] == "POSITIVE"
    assert {r["response_status_id"] for r in run().collect()} == set(rows)
    report = studies.reply_report(run(overwrite=True))
    assert report["ate"].first()["n_strata"] == 1 and report["association"].first()["n"] == 4


def test_before_after_report(spark):
    rows = [
        # post 1 is negative: ann turns negative, bob stays half; post 2 is not: ann stays, cat has one side only.
        ("NEGATIVE", "1", "ann", 0, "POSITIVE"), ("NEGATIVE", "1", "ann", 1, "NEGATIVE"),
        ("NEGATIVE", "1", "bob", 0, "NEGATIVE"), ("NEGATIVE", "1", "bob", 0, "POSITIVE"),
        ("NEGATIVE", "1", "bob", 1, "NEGATIVE"), ("NEGATIVE", "1", "bob", 1, "POSITIVE"),
        ("POSITIVE", "2", "ann", 0, "NEGATIVE"), ("POSITIVE", "2", "ann", 1, "NEGATIVE"),
        ("POSITIVE", "2", "cat", 1, None),
    ]
    study = spark.createDataFrame(
        rows, "source_label string, source_status_id string, response_user_id string, is_after int, response_label string"
    )
    got = {(r["part"], r["term"], r["measure"]): r["value"] for r in studies.long_report(studies.before_after_report(study)).collect()}
    assert (got["study", None, "n"], got["study", None, "n_users"], got["both_sides", None, "n"]) == (9, 3, 8)
    assert got["arms", "x=1, after=1", "rate"] == pytest.approx(2 / 3) and got["arms", "x=0, after=1", "rate"] == 0.5
    assert got["difference", None, "change"] == pytest.approx((2 / 3 - 1 / 3) - (0.5 - 1))
    # Within users: (1 + 0) / 2 behind post 1, nothing behind post 2; bob's halves leave a variance of 1/2 over 2 squared.
    assert got["effect", None, "ate"] == pytest.approx(0.5)
    assert got["effect", None, "variance"] == pytest.approx(0.125)
    empty = studies.long_report(studies.before_after_report(study.limit(0))).collect()
    assert {r["value"] for r in empty if r["part"] == "study"} == {0.0}


def test_before_and_after(posts, sources):
    rows = studies.before_and_after(sources, posts, ACCOUNT, scorer, near_seconds=3600, band_seconds=600).collect()
    got = {(r["response_status_id"], r["side"], r["source_status_id"], r["is_after"]) for r in rows}
    # Ann's marks: 100 at 20:05 and 101 at 20:09; Bob's: 100 at 20:07, 101 at 20:08 and 20:40.
    # Pairs stay when the post lies within ten minutes of the source post (20:00 and 20:30).
    assert got == {("2", "before", "100", 1), ("3", "after", "100", 1), ("4", "before", "100", 1)}
    assert parse_post_time  # the times above come through the post format

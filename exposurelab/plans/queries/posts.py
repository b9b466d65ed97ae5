"""Nested posts made from the conversations, and the two studies on them.

Turns become posts: the assistant is the account under study, everyone else a
user of their own conversation.  Some turns reply to, quote or repost the turn
before; some do two of these at once, to show the precedence.
"""


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.times import format_post_time, parse_post_time
from ...operators import explore, posts as op
from ...operators.scorer import keyword_scorer
from ...plans import studies
from ...session import scratch_path
from ...sources.readers import read_posts
from ...sources.sinks import write_json
from .registry import Tables, query, rounded

ACCOUNT = "assistant"
SCORER = keyword_scorer(["the", "and", "von", "de"], ["of", "to", "la", "un"])


def nested_posts(t: Tables) -> DataFrame:
    """Posts with the schema of the post files."""
    last = Window.partitionBy("conv_id").orderBy("turn")
    turn = F.col("turn")
    moment = F.timestamp_seconds(F.lit(1577836800) + F.col("conv_id") * 3600 + turn * 420)
    rows = (
        t.conversations.withColumn("id", F.col("conv_id") * 100 + turn)
        .withColumn("name", F.when(F.col("role") == ACCOUNT, ACCOUNT).otherwise(F.concat(F.lit("user_"), F.col("conv_id").cast("string"))))
        .withColumn("created_at", format_post_time(moment))
        .withColumn("full_text", F.concat(F.lit("  "), F.col("text"), F.lit(" https://t.co/x"), F.col("id").cast("string")))
        .withColumn("stop", F.when(turn % 2 == 1, F.length("full_text")).otherwise(F.length("text") + 2))
    )
    inner = F.struct(
        "id",
        F.col("id").cast("string").alias("id_str"),
        "created_at",
        "full_text",
        F.array(F.lit(0), F.col("stop")).alias("display_text_range"),
        F.struct(F.col("name").alias("screen_name")).alias("user"),
    )
    rows = rows.withColumn("inner", inner).withColumn("parent", F.lag("inner").over(last))
    has = F.col("parent").isNotNull()
    reply = has & (turn % 3 == 1)
    quote = has & ((turn % 3 == 2) | (turn % 4 == 3))
    repost = has & (turn % 3 == 0)
    return rows.select(
        "id",
        F.col("inner.id_str").alias("id_str"),
        "created_at",
        "full_text",
        "text",
        (turn % 5 == 0).alias("truncated"),
        F.col("inner.display_text_range").alias("display_text_range"),
        F.lit("en").alias("lang"),
        F.col("role").alias("source"),
        quote.alias("is_quote_status"),
        F.when(reply, F.col("parent.id")).alias("in_reply_to_status_id"),
        F.when(reply, F.col("parent.id_str")).alias("in_reply_to_status_id_str"),
        F.when(reply, F.col("parent.user.screen_name")).alias("in_reply_to_screen_name"),
        F.struct(
            F.col("conv_id").alias("id"),
            F.col("conv_id").cast("string").alias("id_str"),
            F.col("name").alias("screen_name"),
            F.length("text").cast("long").alias("followers_count"),
            (F.col("conv_id") + 2).alias("friends_count"),
            turn.alias("listed_count"),
            F.col("created_at").alias("created_at"),
            (F.col("conv_id") * turn).alias("statuses_count"),
            F.lit("somewhere").alias("location"),
        ).alias("user"),
        F.when(quote, F.col("parent")).alias("quoted_status"),
        F.when(repost, F.col("parent")).alias("retweeted_status"),
    )


POSTS = r"""
base as (select conv_id, turn, role, text, conv_id * 100 + turn as id, 1577836800 + conv_id * 3600 + turn * 420 as second,
                case when role = 'assistant' then 'assistant' else 'user_' || conv_id end as name,
                '  ' || text || ' https://t.co/x' || (conv_id * 100 + turn) as full_text from conversations),
shown as (select *, case when turn % 2 = 1 then full_text else '  ' || text end as visible from base),
clean as (select *, regexp_replace(regexp_replace(regexp_replace(visible, 'https://t\.co/\w+$', ''), '^[\s\p{Z}\x1c-\x1f]+', ''),
                                   '[\s\p{Z}\x1c-\x1f]+$', '') as display_text from shown),
linked as (select c.*, lag(id) over w as parent_id, lag(name) over w as parent_name, lag(display_text) over w as parent_text,
                  lag(second) over w as parent_second from clean c window w as (partition by conv_id order by turn)),
posts as (select *, parent_id is not null and turn % 3 = 1 as is_reply,
                 parent_id is not null and (turn % 3 = 2 or turn % 4 = 3) as is_quote,
                 parent_id is not null and turn % 3 = 0 as is_repost from linked),
kinds as (select *, case when is_reply then 'reply' when is_quote then 'quote' when is_repost then 'retweet' end as kind from posts)
"""


@query(f"""with {POSTS}
select cast(id as varchar) as p_status_id, cast(conv_id as varchar) as p_user_id, name as p_screen_name,
       display_text as p_display_text, second as p_second, kind as interaction_type,
       case when kind is not null then cast(parent_id as varchar) end as interaction_status_id,
       case when kind is not null then parent_name end as interaction_screen_name,
       case when kind in ('quote', 'retweet') then parent_text end as interaction_display_text,
       case when kind in ('quote', 'retweet') then parent_second end as interaction_second,
       length(text) as p_user_followers_count, second as p_user_second, 'somewhere' as p_user_location from kinds""")
def flatten_posts(t):
    flat = op.flatten_posts(nested_posts(t), "p")
    second = lambda c: F.unix_seconds(c)
    return flat.select(
        "p_status_id", "p_user_id", "p_screen_name", "p_display_text", second(F.col("p_created_at")).alias("p_second"),
        "interaction_type", "interaction_status_id", "interaction_screen_name", "interaction_display_text",
        second(F.col("interaction_created_at")).alias("interaction_second"), "p_user_followers_count",
        second(parse_post_time("p_user_created_at")).alias("p_user_second"), "p_user_location",
    )


@query(f"with {POSTS} select id, kind, is_reply or is_quote as answers from kinds")
def classify_interaction(t):
    answers = F.col("in_reply_to_status_id_str").isNotNull() | F.col("quoted_status").isNotNull()
    return nested_posts(t).select("id", op.interaction_kind().alias("kind"), answers.alias("answers"))


@query(f"""with {POSTS}
select id, case when kind is not null then cast(parent_id as varchar) end as target,
       coalesce(kind is not null and parent_name = 'assistant', false) as to_account from kinds""")
def response_target(t):
    return nested_posts(t).select(
        "id", op.response_id().alias("target"), op.is_response_to(ACCOUNT).alias("to_account")
    )


SCOPE = "(is_reply or is_quote) and parent_name = 'assistant'"


@query(f"with {POSTS} select id from kinds where {SCOPE}")
def reply_scope(t):
    return nested_posts(t).filter(op.reply_scope(ACCOUNT)).select("id")


@query(f"""with {POSTS}
select id from kinds where parent_name = 'assistant' and (is_reply or (is_quote and is_repost))""")
def reply_scope_literal(t):
    return nested_posts(t).filter(op.reply_scope(ACCOUNT, literal=True)).select("id")


@query(f"with {POSTS} select id, display_text as visible, length(display_text) as n_chars from kinds")
def clean_text(t):
    shown = nested_posts(t).select("id", op.visible_text().alias("visible"))
    return shown.withColumn("n_chars", F.length("visible").cast("long"))


@query(f"""with {POSTS}
select cast(id as varchar) as p_status_id, cast(conv_id as varchar) as p_user_id, name as p_screen_name,
       name as p_user_screen_name from kinds""")
def prefix_columns(t):
    flat = explore.prefixed(op.flatten_posts(nested_posts(t), "p"), "p_")
    return flat.select("p_status_id", "p_user_id", "p_screen_name", "p_user_screen_name")


@query(f"""with {POSTS}
select id, name, conv_id as user_id, case when is_repost then parent_id else -1 end as repost_id, second from kinds""")
def read_post_files(t):
    """Posts written as JSON lines and scanned with a declared schema."""
    path = scratch_path(t.spark, "posts")
    write_json(nested_posts(t), path)
    posts = read_posts(t.spark, path, pattern="*.json")
    return posts.select(
        "id", F.col("user.screen_name").alias("name"), F.col("user.id").alias("user_id"),
        op.repost_id().alias("repost_id"), F.unix_seconds(parse_post_time("created_at")).alias("second"),
    )


@query(f"with {POSTS} select count(*) as n, count(distinct id) as n_ids, max(second) as latest from kinds")
def read_column_subset(t):
    path = scratch_path(t.spark, "posts")
    write_json(nested_posts(t), path)
    few = read_posts(t.spark, path, "id bigint, created_at string", pattern="*.json")
    return few.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.max(F.unix_seconds(parse_post_time("created_at"))).alias("latest"),
    )


def scores_sql(text: str) -> str:
    words = f"regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')"
    bad = f"len(list_filter({words}, lambda w: w in ('the', 'and', 'von', 'de')))"
    good = f"len(list_filter({words}, lambda w: w in ('of', 'to', 'la', 'un')))"
    return f"""case when {bad} > {good} then 'NEGATIVE' else 'POSITIVE' end as label,
       round((1.0 + greatest({bad}, {good})) / (2.0 + {bad} + {good}), 6) as score"""


SCORED = f"scored as (select *, {scores_sql('display_text')} from kinds)"


def accounts(t: Tables) -> tuple[DataFrame, DataFrame]:
    posts = nested_posts(t)
    by_account = F.col("user.screen_name") == ACCOUNT
    return posts.filter(by_account), posts.filter(~by_account)


@query(f"""with {POSTS}, {SCORED}
select r.kind as interaction_type, cast(r.id as varchar) as response_status_id, r.label as response_label,
       r.score as response_score, cast(s.id as varchar) as source_status_id, s.label as source_label,
       s.score as source_score, s.display_text as source_display_text
from scored r join scored s on r.parent_id = s.id and s.name = 'assistant'
where r.name <> 'assistant' and (r.is_reply or r.is_quote) and r.parent_name = 'assistant'""")
def reply_study(t):
    study = studies.reply_analysis(*accounts(t), ACCOUNT, SCORER, path=scratch_path(t.spark, "reply"))
    return rounded(
        study.select(
            "interaction_type", "response_status_id", "response_label", "response_score",
            "source_status_id", "source_label", "source_score", "source_display_text",
        )
    )


PAIRED = """
users as (select *, coalesce(kind is not null and parent_name = 'assistant', false) as is_mark from scored where name <> 'assistant'),
sides as (
  select r.*, 'before' as side, arg_max(m.parent_id, m.second) as mark_id, max(m.second) as mark_second
  from users r join users m on m.conv_id = r.conv_id and m.is_mark and m.second <= r.second group by all
  union all
  select r.*, 'after', arg_min(m.parent_id, m.second), min(m.second)
  from users r join users m on m.conv_id = r.conv_id and m.is_mark and m.second > r.second group by all),
near as (select id from sides where abs(second - mark_second) < 3600),
pairs as (select * from sides where id in (select id from near) and (is_reply or is_quote))"""


@query(f"""with {POSTS}, {SCORED}, {PAIRED}
select cast(p.id as varchar) as response_status_id, p.side, p.label as response_label, p.score as response_score,
       cast(s.id as varchar) as source_status_id, s.label as source_label, cast(p.second > s.second as int) as is_after
from pairs p join scored s on s.id = p.mark_id and s.name = 'assistant' where abs(p.second - s.second) < 600""")
def before_after_study(t):
    study = studies.before_and_after(*accounts(t), ACCOUNT, SCORER)
    return rounded(
        study.select(
            "response_status_id", "side", "response_label", "response_score", "source_status_id", "source_label", "is_after"
        )
    )


@query()
def reply_report(t):
    study = studies.reply_analysis(*accounts(t), ACCOUNT, SCORER, path=scratch_path(t.spark, "reply"))
    return rounded(studies.long_report(studies.reply_report(study)), 4)


def measures_sql(part: str, source: str, measures: str, term: str = "cast(null as varchar)") -> str:
    """Rows ``part, term, measure, value`` of the columns of a select."""
    return " union all ".join(
        f"select '{part}' as part, {term} as term, '{m}' as measure, round(cast({m} as double), 6) as value from {source}"
        for m in measures.split()
    )


@query(f"""with {POSTS}, {SCORED}, {PAIRED},
study as (
  select cast(s.label = 'NEGATIVE' as int) as x, cast(p.label = 'NEGATIVE' as int) as y, cast(p.second > s.second as int) as is_after,
         s.id as post, p.conv_id as usr
  from pairs p join scored s on s.id = p.mark_id and s.name = 'assistant' where abs(p.second - s.second) < 600),
both_sides as (
  select * from study where (usr, post) in (select (usr, post) from study group by usr, post having count(distinct is_after) > 1)),
sizes as (select count(*) as n, count(distinct usr) as n_users, count(distinct post) as n_posts from study),
kept as (select count(*) as n, count(distinct usr) as n_users, count(distinct post) as n_posts from both_sides),
arms as (select concat('x=', x, ', after=', is_after) as term, count(*) as n, avg(y) as rate from study group by x, is_after),
r as (select x * 2 + is_after as k, avg(y) as rate from study group by 1),
change as (select max(rate) filter (k = 3) - max(rate) filter (k = 2) - max(rate) filter (k = 1) + max(rate) filter (k = 0) as change from r),
sides_of as (select x, post, usr, avg(y) filter (is_after = 0) as b, avg(y) filter (is_after = 1) as a from both_sides group by x, post, usr),
by_user as (select x, post, a - b as d, a * (1 - a) + b * (1 - b) as v from sides_of),
by_post as (select x, avg(d) as d, sum(v) / (count(v) * count(v)) as v from by_user group by x, post),
by_label as (select x, avg(d) as d, sum(v) / (count(v) * count(v)) as v from by_post group by x),
effect as (select max(d) filter (x = 1) - max(d) filter (x = 0) as ate, sum(v) as variance, sqrt(sum(v)) as std_error from by_label)
{measures_sql("study", "sizes", "n n_users n_posts")} union all {measures_sql("both_sides", "kept", "n n_users n_posts")}
union all {measures_sql("arms", "arms", "n rate", "term")} union all {measures_sql("difference", "change", "change")}
union all {measures_sql("effect", "effect", "ate variance std_error")}""")
def before_after_report(t):
    study = studies.before_and_after(*accounts(t), ACCOUNT, SCORER, path=scratch_path(t.spark, "sides"))
    return rounded(studies.long_report(studies.before_after_report(study)))

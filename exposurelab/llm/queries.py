"""One query per operator on the generated tables, with SQL where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_search, crosspolytope, exact_dedup, filter_audit, html_text, license_scan, mixing, packing, secrets, simhash,
    suffix_dedup, toxicity, url_filter,
)

VOCABULARY = "word_bpe_49k.json"
CATEGORIES = ["low_quality", "toxic"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op2_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).withColumn("rate", F.round("rate", 9))


SQL["op2_poisson_mix"] = """
with sizes as (
    select source, sum(length(coalesce(text, '')) + 1)::bigint as size from documents group by source
), weighted as (
    select *, pow(size::double, 0.7) as weight from sizes
), rates as (
    select source, (weight / (select sum(weight) from weighted)) * (select sum(size) from weighted) / size as rate
    from weighted
), parts as (
    select *, greatest(ceil(rate / 16.0), 1)::bigint as parts from rates
), terms as (
    select source, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1)) as p
    from parts, range(0, 97) r(k)
), distribution as (
    select source, k, sum(p) over (partition by source order by k) as c from terms
), draws as (
    select d.doc_id, d.source, (('0x' || substr(md5('mix|' || coalesce(d.doc_id::varchar, '') || '|' || j), 1, 13))::bigint
            + 0.5) / 4503599627370496.0 as u
    from documents d join parts p on d.source is not distinct from p.source, range(0, p.parts) r(j)
), counted as (
    select w.doc_id, w.source, w.u, count(*) as n from draws w join distribution t
        on w.source is not distinct from t.source and t.c <= w.u group by all
), counts as (
    select doc_id, sum(n) as n from counted group by doc_id
)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::int as copy, round(p.rate, 9) as rate,
    ('0x' || substr(md5('mix|order|' || coalesce(d.doc_id::varchar, '') || '|' || c.copy), 1, 13))::bigint as shuffle_key
from documents d join counts n on d.doc_id = n.doc_id join parts p on d.source is not distinct from p.source,
    range(0, n.n::bigint) c(copy)
"""


@query
def op3_url_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


SQL["op3_url_redirects"] = r"""
with recursive named as (
    select page_id, url, html,
        case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
), parsed as (
    select page_id, url, html,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path,
        coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1), '') as tail
    from named
), tags as (
    select *, list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'),
            lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b'))[1] as canonical,
        list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'),
            lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1] as refresh
    from parsed
), targets as (
    select url, host, path, trim(replace(regexp_extract(canonical, '(?is)\bhref\s*=\s*["'']?([^"''>]*)', 1), '&amp;', '&')) as target from tags
    union all
    select url, host, path, trim(replace(regexp_extract(refresh, '(?is)\burl\s*=\s*[''"]?([^"''>\s]+)', 1), '&amp;', '&')) from tags
), resolved as (
    select url as source, case when contains(target, '://') then target when starts_with(target, '//') then 'http:' || target
        when starts_with(target, '/') then 'http://' || host || target
        else 'http://' || host || case when path = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end || target end as target
    from targets where target <> '' and contains(url, '://')
), ends as (
    select source as u, target as v from resolved union select target, source from resolved
), addressed as (
    select translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(substr(u, strpos(u, '://') + 3), '(?s)^[^/?#]*([^#]*)', 1) as a,
        translate(regexp_extract(substr(v, strpos(v, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(substr(v, strpos(v, '://') + 3), '(?s)^[^/?#]*([^#]*)', 1) as b
    from ends
), reach(node, other) as (
    select a, a from addressed where a <> b union select r.node, e.b from reach r join addressed e on r.other = e.a
), groups as (
    select node, min(other) as component from reach group by node
), rules(verdict, host, path) as (
    values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), places as (
    select distinct host, path from parsed
    union select regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) from groups
), decided as (
    select p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
    from places p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    group by p.host, p.path
), known as (
    select g.component, bool_or(d.verdict = 'block') as blocked, bool_or(d.verdict = 'allow') as allowed
    from groups g left join decided d on d.host = regexp_extract(g.node, '^([^/?#]*)', 1)
        and d.path = regexp_extract(g.node, '(?s)^[^/?#]*([^?#]*)', 1)
    group by g.component
)
select p.page_id, p.host, p.path, d.rule, coalesce(d.verdict, case when k.allowed then 'allow' when k.blocked then 'block' else 'allow' end) as verdict,
    coalesce(g.component, p.host || p.tail) as component
from parsed p left join decided d on d.host = p.host and d.path = p.path
left join groups g on g.node = p.host || p.tail left join known k on k.component = g.component
"""


@query
def op4_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    rows = crosspolytope.links(table(spark, folder, "embeddings"))
    kept = F.col("id") == F.col("component")
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


SQL["op4_cross_polytope"] = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
), usable as (
    select * from v where label is not null and len(e) > 0
        and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as x, b.vec_id as y from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, other) as (
    select vec_id, vec_id from v union select r.node, l.y from reach r join links l on r.other = l.x
), components as (
    select node, min(other) as component_id from reach group by node
), counts as (
    select x, count(*) as n from links group by x
)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
from v join components on v.vec_id = node left join counts on v.vec_id = x
"""


def toxicity_chain(spark: SparkSession, folder: str) -> toxicity.Chain:
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(table(spark, folder, "documents"), labels, CATEGORIES)


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity.score(table(spark, folder, "documents"), toxicity_chain(spark, folder))
    return scores.withColumn("rejected", F.col("p_toxic") >= toxicity.THRESHOLD).withColumnRenamed("id", "doc_id")


@query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL["op6_exact_dedup"] = """
with folded as (
    select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
    from documents
)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
    doc_id is not distinct from max(doc_id) over (partition by h) as kept, h as text_sha256
from folded
"""


@query
def op7_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


# In these pages the article element holds the article and nothing else.
SQL["op7_line_blocks"] = r"""
with articles as (
    select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as a from pages
), pieces as (
    select page_id, unnest(string_split_regex(a, '</?(?:p|h1)>')) as piece,
        generate_subscripts(string_split_regex(a, '</?(?:p|h1)>'), 1) as place
    from articles
), blocks as (
    select page_id, place, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(piece, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as block
    from pieces
), texts as (
    select page_id, string_agg(block, chr(10) || chr(10) order by place) as text from blocks where block <> '' group by page_id
)
select page_id, url, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from articles left join texts using (page_id)
"""


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("node")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_secret_entropy(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.scan(table(spark, folder, "documents"))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    everything = secrets.in_order(F.concat("base", "added"))
    return rows.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined(everything).alias("spans"),
    )


def _spans_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of the matches of a pattern, from the lengths of the pieces around them."""
    pattern = pattern.replace("'", "''")
    return f"""
select doc_id, '{kind}' as kind, whole as match, before + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::bigint as a
from (select *, ms[i] as whole, gs[i] as measured, list_sum(list_transform(ps[1:i], lambda x: length(x)))::bigint as before
      from (select doc_id, ms, ps, gs, unnest(range(1, len(ms) + 1)) as i
            from (select doc_id, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as gs,
                         string_split_regex(t, '{pattern}') as ps
                  from texts where regexp_matches(t, '{pattern}'))))
where length(measured) >= {least}"""


def _hot_sql(c: secrets.EntropyClass) -> str:
    """Stretches of hot windows; a candidate of one repeated unit never has any."""
    allowed = " ".join(f"and not regexp_matches(match, '{p}')" for p in secrets.ALLOWED[1:])
    return f"""
select doc_id, kind, min(a + w) as a, max(a + w) + {c.window} as b
from (select doc_id, kind, a, match, unnest(range(0, length(match) - {c.window} + 1)) as w
      from candidates where kind = '{c.kind}' {allowed})
where list_entropy(string_split(substr(match, w + 1, {c.window}), '')) >= {c.bits} - 1e-9 group by doc_id, kind, a, match"""


_KINDS = [b[0] for b in secrets.BASE] + [c.kind for c in secrets.CLASSES]
SQL["op9_secret_entropy"] = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
base as ({" union all ".join(f"select doc_id, kind, a, a + length(match) as b from ({_spans_sql(k, secrets.SEARCHED.get(k, p), g, n)})" for k, p, g, n in secrets.BASE)}),
candidates as ({" union all ".join(_spans_sql(c.kind, c.pattern, 0, c.window) for c in secrets.CLASSES)}),
hot_0 as ({_hot_sql(secrets.CLASSES[0])}),
new_0 as (select * from hot_0 h where not exists (select 1 from base s where s.doc_id = h.doc_id and s.a <= h.a and h.b <= s.b)),
hot_1 as ({_hot_sql(secrets.CLASSES[1])}),
new_1 as (select * from hot_1 h where not exists (select 1 from (from base union all from new_0) s where s.doc_id = h.doc_id and s.a <= h.a and h.b <= s.b)),
every as (from base union all from new_0 union all from new_1),
joined as (
    select doc_id, string_agg(kind || ':' || a || ':' || b, ',' order by a, list_position({_KINDS}, kind)) as spans,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, list_position({_KINDS}, kind)) filter (where not starts_with(kind, 'entropy')) as base,
        count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex
    from every group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join joined using (doc_id)
"""


@query
def op10_run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL["op10_run_length_index"] = """
with d as (
    select doc_id, encode(coalesce(text, '')) as b from documents
), strings as (
    select doc_id, i, b[i + 1:i + 200] as s
    from (select doc_id, b, unnest(range(0, octet_length(b) - 199)) as i from d where octet_length(b) >= 200)
), repeated as (
    select doc_id, i from strings where s in (select s from strings group by s having count(*) > 1)
), begun as (
    select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from repeated
), spans as (
    select doc_id, min(i) as a, max(i) + 200 as z
    from (select *, sum(fresh) over (partition by doc_id order by i) as g from begun) group by doc_id, g
), edges as (
    select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as y from spans
), pieces as (
    select doc_id, y, a from edges
    union all
    select d.doc_id, coalesce(max(z), 0), octet_length(any_value(b)) from d left join spans using (doc_id) group by d.doc_id
), kept as (
    select doc_id, string_agg(hex(b[y + 1:a]), '' order by a) as h from pieces join d using (doc_id) group by doc_id
), totals as (
    select doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id
)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(h)) as kept_sha256
from d join kept using (doc_id) left join totals using (doc_id)
"""


@query
def op11_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = license_scan.scan(table(spark, folder, "documents"))
    starts = F.transform("phrases", lambda s: s["start"].cast("long"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return rows.select(
        F.col("id").alias("doc_id"), "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "detections.label")).alias("labels"), "score",
    )


def _rule_values() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    rules = license_scan.parse_rules(license_scan.RULES)
    rows = [(i, r.priority, license_scan.CONFIDENCE[r.priority], quote(r.label), quote(r.pattern)) for i, r in enumerate(rules)]
    rows += [(-1, 0, license_scan.PHRASE_CONFIDENCE, quote(v), quote(license_scan.spaced(k))) for k, v in license_scan.PHRASES.items()]
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


# Every rule on every text, without keywords.  Order -1: phrases.
SQL["op11_license_rules"] = rf"""
with rules(ord, priority, confidence, label, pattern) as (
    values {_rule_values()}
), texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from documents
), spelled as (
    select doc_id, len(words) as n_words, ' ' || array_to_string(words, '  ') || ' ' as t from texts
), found as (
    select doc_id, ord, priority, confidence, label, ms, string_split_regex(t, pattern) as ps
    from (select doc_id, t, r.*, regexp_extract_all(t, pattern) as ms from spelled, rules r where regexp_matches(t, pattern))
), numbered as (
    select *, unnest(range(1, len(ms) + 1)) as i from found
), placed as (
    select doc_id, ord, priority, confidence, label, ms[i] as m,
        (length(array_to_string(ps[1:i], '')) - length(replace(array_to_string(ps[1:i], ''), ' ', '')) + length(array_to_string(ms[1:i - 1], '')) - length(replace(array_to_string(ms[1:i - 1], ''), ' ', ''))) // 2 as a,
        (length(ms[i]) - length(replace(ms[i], ' ', ''))) // 2 as size
    from numbered
), spans as (
    select *, a + size as b from placed
), standing as (
    select * from spans d where ord = -1 or not exists (
        select 1 from spans e where e.doc_id = d.doc_id and e.ord >= 0 and e.ord <> d.ord and e.a <= d.a and e.b >= d.b and (e.priority > d.priority
            or e.priority = d.priority and (e.size > d.size or e.size = d.size and e.ord < d.ord)))
), joined as (
    select doc_id, count(*) filter (ord = -1) as n_base, min(a) filter (ord = -1) as first_word, max(a) filter (ord = -1) as last_word,
        string_agg(distinct label, ',' order by label) filter (ord = -1) as base_labels, string_agg(distinct label, ',' order by label) as labels,
        max(confidence) as score
    from standing group by doc_id
)
select doc_id, n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from spelled left join joined using (doc_id)
"""


@query
def op12_removal_potential(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Every order is walked through; Shapley values are the sums of what filters remove.
SQL["op12_removal_potential"] = r"""
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
), failed as (
    select t.*, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
    from texts t
), counted as (
    select part, mask, count(*) as n, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as good,
        count(*) filter (doc_id in (select doc_id from labels where toxic = 1)) as toxic
    from failed group by part, mask
), letters(f) as (
    values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
    select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
    select filter_order, step::int as step, substr(filter_order, step, 1) as f, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
        list_sum(list_transform(string_split(substr(filter_order, 1, step), ''), lambda x: 1 << (ascii(x) - 65))) as upto
    from orders, range(1, 6) s(step)
), walked as (
    select part, filter_order, step, f, coalesce(sum(n) filter (mask & upto = 0), 0) as kept,
        coalesce(sum(n) filter (mask & upto = own), 0) as removed,
        coalesce(sum(n) filter (mask & own > 0 and mask & upto <> own), 0) as redundant,
        coalesce(sum(n) filter (mask = own), 0) as unique_fails,
        coalesce(sum(good) filter (mask & upto = own), 0) as good_lost, coalesce(sum(toxic) filter (mask & upto = own), 0) as toxic_lost
    from counted, (select filter_order, step, f, own::int as own, upto::int as upto from steps) group by part, filter_order, step, f
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
    unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, f))::bigint as shapley
from walked
"""


@query
def op13_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ball_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op13_ball_tree"] = r"""
with counted as (
    select doc_id, t, count(*) as tf
    from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents)
    group by doc_id, t
), lengths as (
    select doc_id, sum(tf)::bigint as n from counted group by doc_id
), stats as (
    select count(*) as docs, sum(n)::bigint as l from lengths
), asked as (
    select item_id, t, count(*) as repeats
    from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
    group by item_id, t
), weights as (
    select t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::double))::bigint as w
    from (select t, count(*) as df from counted group by t), stats
), scored as (
    select item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::bigint as score
    from asked join weights using (t) join counted using (t) join lengths using (doc_id), stats group by item_id, doc_id
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""

"""URL filtering by rules, carried along redirects and canonical links.

A rule decides every url it fits.  Pages that redirect or name a canonical url are
aliases of it; connected components over these links carry a block to all aliases
that no rule decides, unless a rule allows one of them: an allow goes before a block.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case, quoted, store
from .components import connected_components

# Rules are tried one by one on each url; longer lists belong into a table.
MAX_RULES = 1_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the production query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The host, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(fold_case(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query: what names a page, whatever its scheme and fragment."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1), F.lit("")))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``size, allow, rule, verdict`` of the longest rule that fits (allow first among equals), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fitting = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(
                F.lit(len(r.text)).alias("size"), F.lit(r.verdict == "allow").alias("allow"),
                F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,verdict:string>")


# Fixed values of HTML: the two ways a page names another address for itself.
CANONICAL = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
)
REFRESH = (
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*['"]?([^"'>\s]+)"""
)


def resolve(target: Column, url: Column) -> Column:
    """An absolute url for a link found on the page ``url``."""
    host, path = host_of(url), path_of(url)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(target.contains("://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(F.lit("http://"), host, target))
        .otherwise(F.concat(F.lit("http://"), host, folder, target))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target`` urls of the canonical links and redirects that pages state."""
    html = quoted(html_col)
    canonical = F.concat(*[F.regexp_extract(html, CANONICAL, i) for i in (1, 2, 3)])
    found = pages.select(
        quoted(url_col).alias("source"),
        F.explode(F.array(
            F.when(html.rlike(r"(?i)\bcanonical\b"), canonical),
            F.when(html.rlike(r"(?i)\brefresh\b"), F.regexp_extract(html, REFRESH, 1)),
        )).alias("target"),
    )
    named = found.select("source", F.trim(F.replace("target", F.lit("&amp;"), F.lit("&"))).alias("target"))
    named = named.filter("source is not null and target <> ''")
    return named.select("source", resolve(F.col("target"), F.col("source")).alias("target"))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    links: DataFrame | None = None,
) -> DataFrame:
    """``<id>, host, path, rule, verdict, component`` for every page row.

    ``links`` adds aliases known from elsewhere (``source, target`` urls, such as a
    redirect log) to those in the pages; targets need not be pages.  ``component``
    is the smallest address among the aliases.  Urls that are null or without
    ``://`` have an empty host and path, take part in no alias and are allowed.
    Repeated rows and ids are judged row by row; an empty table gives no rows.
    """
    spark = pages.sparkSession
    stated = []
    if html_col is not None:
        stated.append(page_links(pages, url_col, html_col))
    if links is not None:
        stated.append(links.select("source", "target"))
    url = quoted(url_col)
    rows = pages.select(
        quoted(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    if stated:
        ends = stated[0] if len(stated) == 1 else stated[0].unionByName(stated[1])
        ends, _ = store(ends.filter("source is not null and target is not null").distinct(), "url-links")
        groups = alias_groups(ends, rules)
    else:
        groups = spark.createDataFrame([], "address string, component string, blocked boolean, allowed boolean")
    joined = rows.join(groups, "address", "left")
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).otherwise(
        F.when(F.coalesce("allowed", F.lit(False)), F.lit("allow"))
        .when(F.coalesce("blocked", F.lit(False)), F.lit("block"))
        .otherwise(F.lit("allow"))
    )
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("component", "address").alias("component"),
    )


def alias_groups(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``address, component, blocked, allowed`` for the addresses of linked urls."""
    source, target = F.col("source"), F.col("target")
    named = links.filter((F.instr(source, "://") > 0) & (F.instr(target, "://") > 0))
    members = connected_components(named.select(address_of(source).alias("a"), address_of(target).alias("b")))
    # Host and path come back out of the address; the query begins at its question mark.
    as_url = F.concat(F.lit("http://"), F.col("node"))
    judged = members.withColumn("best", best_rule(host_of(as_url), path_of(as_url), rules))
    decided = judged.groupBy("component").agg(
        F.max(F.coalesce(F.col("best.verdict") == "block", F.lit(False))).alias("blocked"),
        F.max(F.coalesce(F.col("best.verdict") == "allow", F.lit(False))).alias("allowed"),
    )
    return members.join(decided, "component").select(F.col("node").alias("address"), "component", "blocked", "allowed")

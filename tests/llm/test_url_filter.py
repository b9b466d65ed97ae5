import pytest

from exposurelab.llm import url_filter
from exposurelab.llm.queries import QUERIES, SQL
from exposurelab.llm.url_filter import Rule
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def judged(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)
    return {r["page_id"]: r for r in url_filter.judge(pages, **options).collect()}


def test_query_equals_sql(spark):
    assert compare(QUERIES["op3_url_redirects"](spark, SF), connect(SF), SQL["op3_url_redirects"]) is None


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/enx", "example.net", "/enx", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("ftp://www.example.com/de/a", "www.example.com", "/de/a", "example.com/de/", "block"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?/a", "x.net", "", None, "allow"),
        ("http://x.net#://y", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    row = judged(spark, [(url, None)])[0]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_blocks_reach_aliases_and_allows_go_first(spark):
    link = '<head><link href="%s" rel=canonical></head>'.__mod__
    rows = [
        ("http://one.com/a", link("http://bad.net/x")),  # an alias of a blocked address
        ("http://two.com/b", '<META content="0; url=http://one.com/a" HTTP-EQUIV="Refresh">'),
        ("https://one.com/a#part", None),  # the same address
        ("http://three.com/c", link("/d/e?x=1&amp;y=2")),
        ("http://three.com/d/e?x=1&y=2", link("//bad.net/y")),
        ("http://www.example.net/en/ok", link("http://bad.net/z")),  # allowed by a rule
        ("http://four.com/", link("http://bad.net/z")),  # shares a group with an allowed page
        ("http://free.com/", link("http://free.com/home")),
        ("http://bad.net/z", None),
    ]
    found = judged(spark, rows)
    assert [found[i]["verdict"] for i in range(9)] == [
        "block", "block", "block", "block", "block", "allow", "allow", "allow", "block",
    ]
    assert len({found[i]["component"] for i in (0, 1, 2)}) == 1


def test_links_from_elsewhere_and_long_chains(spark):
    rows = [(f"http://h{i}.com/", None) for i in range(40)] + [("http://z.net/", None)]
    hops = [(f"http://h{i}.com/", f"http://h{i + 1}.com/") for i in range(39)] + [("http://h39.com/", "http://z.net/"), (None, "x")]
    links = spark.createDataFrame(hops, "source string, target string")
    found = judged(spark, rows, links=links, html_col=None)
    assert {r["verdict"] for r in found.values()} == {"block"}


def test_longest_rule_and_limits(spark):
    rules = [Rule("block", "a.com", "/"), Rule("allow", "a.com", "/x"), Rule("block", "a.com", "/x/y")]
    urls = ["http://a.com/q", "http://a.com/x", "http://a.com/x/y/z"]
    found = judged(spark, [(u, None) for u in urls], rules=rules)
    assert [found[i]["verdict"] for i in range(3)] == ["block", "allow", "block"]
    assert judged(spark, [("http://a.com/", None)], rules=[])[0]["verdict"] == "allow"
    with pytest.raises(ValueError):
        judged(spark, [("http://a.com/", None)], rules=rules * 400)


def test_odd_pages(spark):
    rows = [(None, "http://a.net/", "<p>", "v"), (None, "http://a.net/", "<p>", "v"), (1, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES + ", verdict string")
    assert sorted(r["verdict"] for r in url_filter.judge(pages).collect()) == ["allow", "block", "block"]
    assert url_filter.judge(pages.limit(0)).count() == 0

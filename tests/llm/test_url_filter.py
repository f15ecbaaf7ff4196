from reliefspark.llm import graph, url_filter
from reliefspark.llm.queries import RULES, _url_sql

PAGES = [
    (1, "https://Shop.Example.net/a?x=1#top", '<link rel="canonical" href="https://pages.example.org/es/9">'),  # alias of a blocked place
    (2, "http://mirror.test/x", "<META HTTP-EQUIV='refresh' CONTENT='0; url=//shop.example.net/a?x=1&amp;'>"),
    (3, "http://mirror.test/y", "<meta http-equiv=refresh content=\"5;url=/x\">"), (4, "http://other.test/", "<link href='z' rel=canonical>"),
    (5, "https://good.example.com/fr/1", "<link rel='canonical' href='https://bad.example.com/de/1'>"),  # an allowed alias goes first
    (6, "https://bad.example.com/de/1", None), (7, "https://third.test/q", "<link rel=canonical href=\"https://bad.example.com/de/1\">"),
    (8, None, "<link rel=canonical href='https://a.b/'>"), (9, "no scheme", ""), (10, "://", "x"), (11, "https://EXAMPLE.org/en/12", None), (12, "https://notexample.org/es/1", None),
    (20, "https://one.test/a", "<link rel=canonical><link rel='canonical' href='https://pages.example.org/es/1'>"),  # the first tag names nothing
    (21, "https://two.test/a", "<link rel=canonical href='/login?next=http://other.com/de/'>"),  # a url within a link
    (22, "https://three.test/a", "<!-- <link rel=canonical href='https://bad.example.com/de/1'> --><p>text <!-- open"),
    (23, "https://four.test/a", "<link rel=canonical href='mailto:x@bad.example.com/de/1'><link\n href='https://five.test/' \n rel=canonical>"),
    (24, "https://five.test/", "<meta http-equiv=refresh content='0;url=https://four.test/b'><link rel=canonical href='https://bad.example.com/de/7'>"),
    (25, "https://long.test/", "<link " * 30_000 + "rel=canonical href='https://bad.example.com/de/1'"),
    (13, "https://example.org", None), (14, "https://a.com/fr", None), (15, "https://x.test/p?u=://y", "<link rel=canonical href='#here'>"),
    (1, "https://Shop.Example.net/a?x=1#top", '<link rel="canonical" href="https://pages.example.org/es/9">')]
WANT = {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "allow", 14: "allow", 15: "allow", 20: "block", 21: "allow", 22: "allow", 23: "block", 24: "block", 25: "allow"}


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], "page_id long, url string, html string, node string, verdict string")


def test_verdicts_against_sql(spark):
    import duckdb
    import pandas as pd

    got = sorted(url_filter.judge(pages(spark), RULES).collect(), key=repr)
    con = duckdb.connect()
    con.register("pages_frame", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    con.execute("create table pages as select cast(page_id as bigint) as page_id, url, html from pages_frame")
    want = con.execute(_url_sql())
    names = [d[0] for d in want.description]
    assert sorted([tuple(r[n] for n in names) for r in got], key=repr) == sorted(want.fetchall(), key=repr)
    verdicts = {r.page_id: r.verdict for r in got}
    # page 2 leads to a url with an empty last parameter, another place than page 1
    assert verdicts == WANT and len(got) == len(PAGES)
    assert {r.page_id: r.rule for r in got}[11] == "example.org/en/1" and {r.page_id: r.rule for r in got}[6] == "com/de/"


def test_empty_table(spark):
    assert url_filter.judge(pages(spark, []), RULES).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 400)] + [(500, 500), (None, 3), (501, 502), (502, 501), (501, 502)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 400)}, 501: 501, 502: 501}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    url_filter.judge(pages(spark), RULES).explain()
    assert "Python" not in capsys.readouterr().out


def test_long_lists_of_rules_and_ties(spark):
    """Thousands of rules as a table; of two rules of one length the later one by verdict, host and path decides."""
    rules = [("block", f"h{i}.test", "/x") for i in range(5000)] + [("allow", "h7.test", "/x/y"), ("allow", "t.test", "/ab"), ("block", "t.test", "/ab"), ("allow", "test", "/")]
    rows = [(i, f"https://sub.h{i}.test/x/y" if i % 2 else f"https://h{i}.test/z", None) for i in range(40)] + [(50, "http://t.test/abc", None), (51, "http://x/y", None)]
    table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages(spark, rows), table).collect()}
    want = {i: (f"h{i}.test/x", "block") if i % 2 else ("test/", "allow") for i in range(40)} | {7: ("h7.test/x/y", "allow"), 50: ("t.test/ab", "block"), 51: (None, "allow")}
    assert got == want

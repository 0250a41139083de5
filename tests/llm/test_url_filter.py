import random

import duckdb

from delayspark.llm import url_filter as U
from delayspark.llm.graph import components
from delayspark.llm.queries import URL_RULES
from delayspark.llm.queries_sql import OP10

CANON = '<html><head><LINK href="{}" rel=canonical></head></html>'
JUMP = "<meta http-equiv='Refresh' content='0; URL={}'>"


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict int, node string")
    return {r["page_id"]: r for r in U.judge(df, URL_RULES).collect()}


def test_rules_hosts_and_paths(spark):
    urls = {1: "http://WWW.Example.com/en/x?y#z", 2: "https://a.example.com/en/", 3: "https://x.net/es/1", 4: "http://net/fr/a",
            5: "http://notexample.com/en/a", 6: "http://xnet/es/1", 7: None, 8: "no address", 9: "s://b.org", 10: "s://u://v.net/es/",
            11: "http://a.com", 12: "http://x.NET/ES/1", 13: ""}
    got = verdicts(spark, [(k, u, None, "h", 1, "n") for k, u in urls.items()])
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"),
        3: ("x.net", "/es/1", "net/es/", "block"), 4: ("net", "/fr/a", "net/fr/", "block"),
        5: ("notexample.com", "/en/a", "com/", "allow"), 6: ("xnet", "/es/1", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("b.org", "", None, "allow"), 10: ("u:", "//v.net/es/", None, "allow"),
        11: ("a.com", "", None, "allow"), 12: ("x.net", "/ES/1", None, "allow"), 13: ("", "", None, "allow")}


def test_blocks_reach_aliases_and_an_allow_outweighs_them(spark):
    rows = [
        (1, "http://a.org/1", CANON.format("http://b.org/2")), (2, "http://b.org/2/#x", JUMP.format("http://bad.net/es/9?utm_source=q")),
        (3, "https://bad.net/es/9", ""),                                     # 1, 2 alias a blocked page
        (4, "http://c.org/1", CANON.format("//d.org/x?a=1&amp;b=2")), (5, "http://d.org/x?a=1&b=2", JUMP.format("http://e.net/fr/")),
        (6, "http://e.net/fr/", CANON.format("http://shop.com/ok")),         # the class of 4, 5, 6 holds an allow
        (7, "http://f.org/dir/page", CANON.format("other")), (8, "http://f.org/dir/other", CANON.format("http://g.net/es/")),
        (9, "http://h.org/", CANON.format("/")), (10, None, CANON.format("http://bad.net/es/9")), (11, "http://i.org/", "<link rel=canonical>"),
        (11, "http://i.org/", "<link rel=canonical>"),
    ]
    got = verdicts(spark, [(*r, "h", 1, "n") for r in rows])
    assert {k: (r["verdict"], r["reason"]) for k, r in got.items()} == {
        1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("allow", "alias"), 5: ("allow", "alias"),
        6: ("block", "rule"), 7: ("block", "alias"), 8: ("block", "alias"), 9: ("allow", "default"), 10: ("block", "alias"),
        11: ("allow", "default")}


RELATIVE = [
    (1, "http://a.org/en/x/page", CANON.format("../../old/./y")), (2, "http://a.org/old/y", JUMP.format("http://bad.net/es/1")),
    (3, "http://c.org/d/e?x=1", CANON.format("../../../f")), (4, "http://c.org/f", CANON.format("//g.net&#x2F;fr/1")),
    (5, "http://h.org/i/j", CANON.format("?v=2")), (6, "http://h.org/i/j?v=2", CANON.format("http://k.net/es/2")),
    (7, "http://l.org/m", CANON.format("mailto:x")), (8, "http://n.org/o/", CANON.format("p?q=http://r.net/es/")),
    (9, "http://n.org/o/p?q=http://r.net/es/", ""), (10, "http://s.org/t/u", CANON.format("./")), (11, "http://s.org/t", CANON.format("http://v.net/fr/")),
    (12, None, CANON.format("../w")), (13, "http://y.org", CANON.format("z/../b")), (14, "http://y.org/b", CANON.format("http://k.net/es/2"))]


def test_relative_links_are_folded_and_entities_decoded(spark):
    got = verdicts(spark, [(*r, "h", 1, "n") for r in RELATIVE])
    assert {k for k, r in got.items() if r["reason"] == "alias" and r["verdict"] == "block"} == {1, 2, 3, 4, 5, 6, 10, 11, 13, 14}


def test_sql_agrees_on_relative_links(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", RELATIVE)
    want = {tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict, reason FROM ({OP10})").fetchall()}
    got = verdicts(spark, [(*r, "h", 1, "n") for r in RELATIVE])
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["reason"]) for r in got.values()} == want


def test_no_pages(spark):
    assert verdicts(spark, []) == {}


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] \
        + [(700, 701 + i) for i in range(50)] + [(3, 3), (None, 4), (5, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

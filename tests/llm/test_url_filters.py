import duckdb

from weft.llm import queries, url_filters


def plain(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, None, default))
    return host, path, best[1], best[2]


URLS = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "https://a.example.com/en", "http://x.net/es/", "http://net/fr/?q", "http://example.com?x=/en/", "no scheme", "", None, "://", "http://a.b.c.example.com/en/" + "x" * 5000, "http://notexample.com/en/", "a://b://www.example.com/en/", "http://example.com./en/1", "x", "http://x.net/es/"]


def test_rules_of_every_kind(spark):
    rules = [*queries.URL_RULES, ("b.c.example.com", "", "block"), ("example.com", "/en/x", "allow")]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = url_filters.filter_urls(pages, spark.createDataFrame(rules, url_filters.RULE_SCHEMA), keep=["page_id"]).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: plain(u, rules) for k, u in enumerate(URLS)}
    assert len(got) == len(URLS)


def test_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filters.RULE_SCHEMA)
    assert [tuple(r) for r in url_filters.filter_urls(pages, none, "block", keep=["page_id"]).collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filters.filter_urls(pages.limit(0), none).count() == 0


def test_long_rule_list_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 1)
    test_rules_of_every_kind(spark)


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{at}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op8_url_filters"]).fetchall()
    assert sorted(map(str, map(tuple, queries.op8_url_filters(spark, at).collect()))) == sorted(map(str, want))

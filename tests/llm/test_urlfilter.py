from marlstone.llm import urlfilter

PAGES = [
    (1, "http://A.Example.com/en/1?x"), (2, "https://x.example.com/en/70"), (3, "http://net/de/"), (4, "http://a.example.net/de/81#f"), (5, None), (6, "no scheme"),
    (7, "http://bad.org/fr/1"), (8, "http://bad.org/fr/2"), (9, "http://bad.org"), (10, "ftp://a.org?q=/es/1"), (11, "http://xcom/en/1"), (1, "http://A.Example.com/en/1?x"), (None, "http://good.org/fr/9://z/"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(*p, "allow") for p in PAGES], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (None, 1), (2, 0)], "item long, bad int")
    rows = urlfilter.judge(pages, outcomes).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: r for r in rows}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/7", "allow")
    assert (got[3].host, got[3].rule, got[3].verdict) == ("net", "net/de/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.net/de/8", "block")
    assert (got[5].host, got[5].path, got[5].rule) == ("", "", None) == (got[6].host, got[6].path, got[6].rule)
    assert (got[10].host, got[10].path, got[10].rule) == ("a.org", "", None)
    assert got[11].rule is None and got[9].path == ""
    assert got[None].path == "/fr/9://z/"
    assert got[7].verdict == got[9].verdict and got[7].bad_bound > got[None].bad_bound
    assert urlfilter.judge(pages.limit(0), outcomes).count() == 0


def test_without_outcomes_nothing_is_blocked_by_reputation(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    rows = urlfilter.judge(pages, spark.createDataFrame([], "item long, bad int")).collect()
    assert all(r.verdict == "allow" for r in rows if r.rule is None)


def test_many_bad_pages_block_a_host(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.org/fr/{k}") for k in range(200)], "page_id long, url string")
    outcomes = spark.createDataFrame([(k, k % 2) for k in range(0, 200)], "item long, bad int")
    assert {(r.host, r.verdict) for r in urlfilter.judge(pages, outcomes).collect()} == {("bad.org", "block"), ("good.org", "allow")}


def test_registries_with_two_labels(spark):
    hosts = [("shop.co.uk", 4, 4), ("www.shop.co.uk", 2, 2), ("clean.co.uk", 900, 0), ("a.com", 50, 0), ("b.com", 10, 1), ("co.uk", 0, 0), ("localhost", 1, 0)]
    counts = spark.createDataFrame(hosts, "host string, n long, bad long")
    share = lambda **k: {r.host: r.alpha / (r.alpha + r.beta) for r in urlfilter.reputation(counts, **k).collect()}
    own, one = share(), share(second_level=())
    assert own["www.shop.co.uk"] > one["www.shop.co.uk"] and len(own) == 7

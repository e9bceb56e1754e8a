from bizlens.llm import urls

URLS = [
    (1, "https://WWW.Example.NET/en/1?x=/de/"), (2, "http://example.net"), (3, "http://example.net/"),
    (4, "https://a.example.com/de/1"), (5, "https://notexample.com/de/1"), (6, "ftp://x.org/fr/#a"), (7, None), (8, "no scheme/en/"),
    (9, "http://spam-farm.example.org/en/1"), (10, "http://www.spam-farm.example.org/fr/1"), (11, "a://b.net/c://d.org/fr/"),
    (12, ""), (13, "http://.net/x"), (13, "http://.net/x"), (14, "http://net/\nx"),
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = any(label in urls.UNWANTED for label in host.split("."))
    return host, path, rule, verdict or ("block" if listed else "allow")


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")


def _rules(spark):
    return spark.createDataFrame(urls.RULES, "host string, path string, verdict string")


def test_rules_and_method(spark):
    pages = _pages(spark, [(i, u, None, "x", "y") for i, u in URLS])
    got = urls.judge(pages, _rules(spark), urls.unwanted_sites(pages)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted(
        (i, *(x or "" for x in brute(u))) for i, u in URLS
    )
    none = urls.judge(_pages(spark, []), _rules(spark), urls.unwanted_sites(_pages(spark, [])))
    assert none.count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('key', id) AS key")
    listed = spark.range(3000).where("id % 7 = 0").selectExpr("concat('key', id) AS key")
    cascade = urls.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = universe.withColumn("has", cascade.has(universe["key"])).where("has").select("key")
    assert sorted(r.key for r in got.collect()) == sorted(r.key for r in listed.collect())


def test_shards_agree(spark):
    universe = spark.range(500).selectExpr("concat('key', id) AS key")
    listed = universe.where("key like '%3'")
    shards = urls._members(universe, listed, max_keys=20)
    assert len(shards) > 1
    got = universe.where(urls._listed(shards, universe["key"]))
    assert sorted(r.key for r in got.collect()) == sorted(r.key for r in listed.collect())

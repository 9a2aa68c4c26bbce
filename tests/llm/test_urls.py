import re

from corpusloom.llm import urls

SCHEMA = "page_id long, url string, html string, host string, rule string, model string, g string"


def frame(spark, found):
    return spark.createDataFrame([(i, u, "h", "x", "r", "m", "g") for i, u in enumerate(found)], SCHEMA)


def rule(host, path):
    fits = [(len(h + p), f"{h}{p}", v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "https://WWW.Example.COM/en/5?x#y", "http://example.com/en/70", "http://a.example.com/en/7", "http://x.net/de/9", "http://example.net/de/81", "http://notexample.net/de/8", "ftp://b.org/es/", "http://org/es/", "http://xorg/es/", "x://h?/en/", "://com/en/1", "http://com#/en/", "http://É.COM/En/", "http://h.com/en", "http://a//b://c/en/"]


def test_rules_and_parts(spark):
    got = {r.page_id: r for r in urls.judge(frame(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (got[i].host, got[i].path) == (host, path)
        name, verdict = rule(host, path)
        assert got[i].rule == name and (verdict is None or got[i].verdict == verdict)
    assert got[0].verdict == got[1].verdict == got[2].verdict == "allow"


def test_model_on_unseen_urls(spark):
    block = ["https://cheap-pills-24.test/a", "http://casino-win-big.test/b", "http://www.free-bets-live.test/c", "https://spam-farm-links.test/d", "http://ads-track-net.test/e"]
    allow = ["https://library.town.test/a", "http://blog.mountain.test/b", "http://www.physics.test/c", "https://m.theatre-news.test/d", "http://school.river.test/e"]
    got = {r.page_id: r.verdict for r in urls.judge(frame(spark, block + allow)).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_plan_is_native_and_empty_table_works(spark):
    out = urls.judge(frame(spark, []))
    assert out.count() == 0
    out = urls.judge(spark.range(2).selectExpr("id AS page_id", "'http://a.test/b' AS url"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan

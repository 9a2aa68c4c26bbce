"""URL filter: longest-rule matching, then hashed n-gram logistic regression.

Everything that touches the table is a Spark expression. The model is fitted on
the driver from SEED_URLS, a table of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# The labelled URLs, blocked ones and allowed ones.
SEED_URLS = {
    "block": (
        "http://www.cheap-pills-online.test/buy/now", "https://cheap-pills.test/offer/12", "http://buy-pills-cheap.test/pharmacy", "https://discount-pharmacy-pills.test/order", "http://viagra-cheap.test/pills/33",
        "https://casino-win.test/play", "http://www.best-casino-bonus.test/slots/7", "https://online-casino-win.test/jackpot", "http://win-casino-slots.test/spin/9", "https://casino-royal-bonus.test/poker",
        "https://free-bets.test/odds", "http://m.free-bets-today.test/football/3", "https://sports-betting-free.test/tips", "http://bets-and-odds.test/free", "https://bet-bonus-free.test/live",
        "http://ads-track.test/click?id=1", "https://www.ads-tracker.test/pixel/5", "http://track-ads.test/banner", "https://adserver-track.test/imp/22", "http://click-ads.test/redirect",
        "http://spam-farm.test/links/4", "https://www.link-farm-seo.test/spam", "http://spam-links-farm.test/page/8", "https://seo-spam.test/buy-links", "http://farm-of-spam.test/index",
        "https://xxx-adult-cams.test/live", "http://adult-xxx-video.test/watch/1", "https://free-xxx.test/porn", "http://porn-tube-free.test/v/77", "https://hot-adult-dating.test/join",
        "http://payday-loan-fast.test/apply", "https://quick-loans-cheap.test/cash", "http://crypto-double-win.test/invest", "https://get-rich-quick.test/offer", "http://free-prize-win.test/claim",
    ),
    "allow": (
        "https://www.university.test/research/physics", "http://library.city.test/catalogue/33", "https://news.daily.test/2020/05/report", "http://blog.writer.test/posts/about-trees", "https://docs.software.test/manual/install",
        "http://museum.test/exhibits/12", "https://recipes.kitchen.test/bread", "http://m.weather.test/forecast/today", "https://journal.science.test/article/881", "http://forum.gardeners.test/thread/19",
        "https://en.encyclopedia.test/wiki/river", "http://www.school.test/lessons/4", "https://travel.guides.test/mountains", "http://history.archive.test/letters/1890", "https://maps.region.test/towns",
        "http://blog.stones.test/geology/3", "https://www.hospital.test/patients/information", "http://government.test/law/section/8", "https://music.festival.test/programme", "http://m.theatre.test/plays/5",
        "https://blog.theorem.test/algebra/7", "http://www.station.test/trains/times", "https://photo.nature.test/birds", "http://books.publisher.test/novel/210", "https://stories.reading.test/chapter/2",
        "http://thing.other.test/there", "https://blog.nation.test/elections/9", "http://www.motion.test/theory", "https://station.weather.test/rain", "http://m.brother.test/letters",
        "https://health.clinic.test/advice", "http://sports.club.test/results/14", "https://garden.plants.test/roses", "http://farm.animals.test/cows", "https://track.railway.test/lines",
    ),
}
BUCKETS, GRAMS, ROUNDS, RATE, DECAY = 4096, (3, 4, 5), 400, 2.0, 1e-3


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty ones for a null or a url without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """Array of the hashed character n-grams of host and path, each marked by its part."""
    grams = []
    for tag, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path)):
        for n in GRAMS:
            size = F.length(part) - (n - 1)
            cut = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), _bucket(tag, part, n))
            grams.append(F.when(size > 0, cut).otherwise(F.array().cast("array<int>")))
    return F.concat(*grams)


def _bucket(tag: str, part: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(tag), F.substring(part, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def _shares(spark: SparkSession) -> list[tuple[int, list[int]]]:
    rows = [f"struct('{k}' AS verdict, '{u}' AS url)" for k, urls in SEED_URLS.items() for u in urls]
    table = spark.sql(f"SELECT inline(array({', '.join(rows)}))")
    host, path = parts(F.col("url"))
    return [(int(r.verdict == "block"), r.g) for r in table.select("verdict", buckets(host, path).alias("g")).collect()]


def fit(spark: SparkSession) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, by full-batch gradient descent.

    A url's features are the shares of its n-grams, so long urls weigh no more.
    """
    table = [(y, {b: math.sqrt(g.count(b) / len(g)) for b in set(g)} if g else {}) for y, g in _shares(spark)]
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(ROUNDS):
        grad, slope = {}, 0.0
        for y, x in table:
            error = 1 / (1 + math.exp(-bias - sum(weights[b] * v for b, v in x.items()))) - y
            slope += error
            for b, v in x.items():
                grad[b] = grad.get(b, 0.0) + error * v
        bias -= RATE * slope / len(table)
        for b, g in grad.items():
            weights[b] -= RATE * (g / len(table) * 10 + DECAY * weights[b])
    return weights, bias


def judge(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url).

    The longest rule that fits a host or its parent domain and the start of the
    path decides; other urls go by the model, an empty host being allowed. Null
    urls have an empty host and path. Repeated rows stay rows; no shuffle.
    """
    weights, bias = fit(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    model = F.array(*[F.lit(round(w, 6)) for w in weights])
    rows = rows.withColumn("g", F.array_sort(buckets(F.col("host"), F.col("path"))))
    # Runs of equal buckets give the counts: a sorted walk adds each bucket's weight times the root of its share.
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    add = lambda acc: acc["sum"] + F.when(acc["b"] >= 0, F.element_at(F.col("model"), F.greatest(acc["b"], F.lit(0)) + 1) * F.sqrt(acc["n"].cast("double"))).otherwise(0.0)
    step = lambda acc, b: F.when(acc["b"] == b, F.struct(b.alias("b"), (acc["n"] + 1).alias("n"), acc["sum"].alias("sum"))).otherwise(F.struct(b.alias("b"), F.lit(1).alias("n"), add(acc).alias("sum")))
    margin = F.aggregate("g", start, step, add) / F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double")) + F.lit(bias)
    score = F.when(F.col("host") == "", 0.0).otherwise(1 / (1 + F.exp(-margin)))
    rows = rows.withColumn("model", model).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")

"""URL filters: longest-match rules, then a logistic regression.

A rule is ``host/path`` and fits that host and all its subdomains when the
url's path starts with the rule's; the rule with most characters wins. Where
no rule fits, a logistic regression on hashed character 2- to 4-grams of host
and path decides; it is trained from a small labelled URL table. Everything
runs in DataFrame and SQL functions (the fit in Spark's own JVM learner).

A null url, or one without ``://``, has empty host and path; no rule fits it
and, having no n-grams, it gets the model's intercept alone. Repeated rows get
equal results.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

ALLOW, BLOCK = "allow", "block"
RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))
ORDERS = (2, 3, 4)
BUCKETS = 1024
REG = 0.01
#: A url is blocked if the model's probability of ``block`` is at least this.
BLOCK_PROBABILITY = 0.5

#: The small labelled URL table.
ALLOWED_URLS = (
    "https://www.example.org/articles/2019/history-of-bridges", "https://blog.sample.net/posts/learning-to-paint",
    "http://news.local.org/science/new-comet-seen", "https://docs.tool.org/guide/install", "https://en.encyclo.org/wiki/Harbour",
    "https://forum.garden.net/topic/roses-in-winter", "https://library.uni.edu/papers/1234", "https://recipes.home.org/bread/rye",
    "https://m.paper.net/de/kultur/8812", "https://shop.books.org/review/long-walk", "https://travel.net/en/guides/lisbon",
    "https://museum.city.org/exhibits/17", "https://health.gov.org/advice/sleep", "https://observatory.org/en/events/25",
    "https://www.orchestra.org/fr/concerts/685", "https://blog.baking.net/de/brot/71", "https://m.railway.net/en/timetable/102",
    "https://www.botanical.org/es/plantas/340", "https://news.harbour.net/en/weather/9", "https://philosophy.org/de/essays/512",
    "https://school.org/lessons/math/fractions", "https://sport.daily.net/match-report/77", "https://music.org/interviews/quartet",
    "https://wiki.code.org/page/sorting")
BLOCKED_URLS = (
    "http://free-casino-bonus.win/slots?ref=77", "http://cheap-pills.biz/buy/viagra-online", "http://ads.track.net/click?id=991",
    "https://login.bank-secure.xyz/verify/account", "http://xxx-video.tube/adult/cam", "https://bet365-poker.info/jackpot/win",
    "http://download-crack.ru/keygen/serial", "https://pixel.adserver.com/impression/track", "http://sexy-dating.club/hot/girls",
    "https://shop.net/cart/checkout", "https://site.com/user/login", "http://payday-loan.top/apply/now",
    "http://win-iphone.click/prize/claim", "https://doubleclick.ads.net/banner/728", "http://torrent-free.to/movie/download",
    "http://replica-watches.shop/cheap/rolex", "https://spam-links.info/seo/backlinks", "http://adult-cams.xyz/live/sex",
    "http://lottery-winner.bid/claim/cash", "https://tracker.ads.biz/redirect?url=x", "http://weight-loss-miracle.pw/pills/order",
    "http://casino-royal.vip/roulette/play", "https://hot-singles.date/join/free", "http://warez-crack.ws/serials/download")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, rule).otherwise(out)
    return out


def gram_buckets(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram of ``^host/path$``; empty if both are."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(k))), F.lit(BUCKETS)).cast("int"))

    grams = F.flatten(F.array(*[of(k) for k in ORDERS]))
    return F.when((host != "") | (path != ""), grams).otherwise(F.array().cast("array<int>"))


def train(spark: SparkSession, allowed: tuple[str, ...] = ALLOWED_URLS, blocked: tuple[str, ...] = BLOCKED_URLS) -> tuple[list[float], float]:
    """Weights (one a bucket) and intercept; the positive class is ``block``."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label"))
                                                     for y, urls in enumerate((allowed, blocked)) for u in urls])).alias("r"))
    grams = gram_buckets(host_of(F.col("r.url")), path_of(F.col("r.url")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(
        F.filter("grams", lambda g: g == b)).cast("double") / F.greatest(F.size("grams"), F.lit(1)))
    rows = rows.select("r.label", grams.alias("grams")).select("label", array_to_vector(counts).alias("features"))
    fitted = LogisticRegression(regParam=REG / BUCKETS, standardization=False, maxIter=60).fit(rows)
    return [float(x) for x in fitted.coefficients], float(fitted.intercept)


def block_probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table = F.lit(weights)
    grams = gram_buckets(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
    z = total / F.greatest(F.size(grams), F.lit(1)) + F.lit(intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
               model: tuple[list[float], float] | None = None) -> DataFrame:
    """``pages`` with a struct column ``url_verdict`` (or a longer free name):
    host, path, rule, probability (of block; null where a rule decides) and
    verdict."""
    weights, intercept = model or train(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host, path = F.coalesce(host_of(url), F.lit("")), F.coalesce(path_of(url), F.lit(""))
    rule = rule_of(host, path, rules)
    p = F.when(rule.isNull(), block_probability(host, path, weights, intercept))
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None).cast("map<string,string>")
    verdict = F.coalesce(F.try_element_at(by_rule, rule), F.when(p >= BLOCK_PROBABILITY, BLOCK).otherwise(ALLOW))
    return pages.withColumn(fresh(pages, "url_verdict"), F.struct(
        host.alias("host"), path.alias("path"), rule.alias("rule"), p.alias("probability"), verdict.alias("verdict")))

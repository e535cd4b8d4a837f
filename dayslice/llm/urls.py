"""URL filter: host and path rules first, else a logistic regression on hashed character n-grams.

DataFrame functions only. The regression is learned from a small labelled table of URLs by Spark's own
LogisticRegression; its weights, a bounded array, are looked up while rows flow, so pages are read once
and not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import LOWER, UPPER

#: (verdict, host with all its subdomains, start of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
GRAM = 3
BUCKETS = 1024
THRESHOLD = 0.5

#: A small labelled table: 1 for addresses that are to be blocked.
LABELLED = (
    ("http://win-casino-bonus.example/slots/free-spins", 1),
    ("http://best-casino.example.org/jackpot/888", 1),
    ("http://poker-bet.example.net/bonus?ref=1", 1),
    ("http://cheap-pills.example.biz/viagra/order", 1),
    ("http://pharmacy-online.example.info/cialis-discount", 1),
    ("http://xxx-videos.example.org/adult/live-cam", 1),
    ("http://hot-cams.example.net/sex/chat", 1),
    ("http://free-download-crack.example.ru/keygen/serial.exe", 1),
    ("http://warez.example.to/torrent/full-crack.zip", 1),
    ("http://secure-login-verify.example.tk/account/update.php", 1),
    ("http://paypa1-secure.example.cf/login/confirm", 1),
    ("http://earn-money-fast.example.biz/get-rich/click.php", 1),
    ("http://ads.tracker.example.net/click?campaign=77", 1),
    ("http://banner-ads.example.org/popunder/redirect", 1),
    ("http://loan-payday.example.info/instant-cash", 1),
    ("http://replica-watches.example.shop/cheap/rolex", 1),
    ("http://lottery-winner.example.tk/claim-prize", 1),
    ("http://crypto-doubler.example.io/send-bitcoin-win", 1),
    ("http://spam-links.example.biz/seo/backlinks-buy", 1),
    ("http://gambling.example.bet/roulette/play-now", 1),
    ("https://www.library.example.org/en/books/history", 0),
    ("https://docs.example.org/en/guide/install.html", 0),
    ("https://news.example.net/en/2024/science/climate", 0),
    ("https://blog.example.org/de/artikel/reise", 0),
    ("https://www.university.example.edu/research/papers", 0),
    ("https://m.weather.example.org/fr/paris/2610", 0),
    ("https://museum.example.org/es/arte/4417", 0),
    ("https://www.recipes.example.net/en/bread/1203.html", 0),
    ("https://wiki.example.org/de/Physik", 0),
    ("https://forum.example.net/en/thread/5521?page=2", 0),
    ("https://shop.example.org/en/books/978", 0),
    ("https://data.example.gov/en/census/table/12", 0),
    ("https://blog.gardening.example.net/en/roses/", 0),
    ("https://www.sports.example.org/en/results/2024", 0),
    ("https://health.example.gov/en/vaccines/faq.html", 0),
    ("https://m.travel.example.net/de/berlin/tipps", 0),
    ("https://code.example.org/en/project/readme", 0),
    ("https://music.example.net/en/review/album", 0),
    ("https://www.city.example.org/es/transporte/", 0),
    ("https://magazine.example.org/en/culture/film", 0),
)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without `://`."""
    text = F.coalesce(url, F.lit(""))
    start = F.locate("://", text)
    rest = F.when(start > 0, F.substr(text, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + 1)
    return _lower(host), F.regexp_extract(after, r"(?s)^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains of it, for paths that start with its own. Length is that of host and
    path together; of equally long rules the earlier wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, size: int = GRAM, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of `^host path$`, each bucket once."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(size))), F.lit(buckets)).cast("int")))


@lru_cache(maxsize=8)
def _weights(spark: SparkSession, labelled: tuple[tuple[str, int], ...], buckets: int) -> tuple[tuple[float, ...], float]:
    rows = spark.createDataFrame(list(labelled), "url string, label int")
    host, path = parts(F.col("url"))
    found = rows.select(F.col("label").cast("double"), grams(host, path, buckets=buckets).alias("grams"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.array_contains("grams", i).cast("double"))
    train = found.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.01, maxIter=50, standardization=False).fit(train)
    return tuple(float(w) for w in model.coefficients.toArray()), float(model.intercept)


def judge(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`pages` with columns host, path, rule, score and verdict; own columns of these names are replaced.

    `verdict` is the rule's where one fits, else block if the regression's probability reaches `threshold`. A null url
    or one without `://` has an empty host and path, fits no rule, and is judged by the regression. Repeated
    rows come out as often as they came in. An empty table gives no rows.
    """
    spark = pages.sparkSession
    weights, bias = _weights(spark, tuple(labelled), BUCKETS)
    table = F.lit(list(weights))
    host, path = parts(F.col(url))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    found = grams(F.col("_host"), F.col("_path"))
    total = F.aggregate(found, F.lit(bias), lambda s, i: s + F.element_at(table, i + 1))
    keep = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    split = pages.select(*keep, host.alias("_host"), path.alias("_path"))
    scored = split.select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        (1 / (1 + F.exp(-total))).alias("score"),
        verdict.alias("_verdict"),
    )
    by_score = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce("_verdict", by_score)).drop("_verdict")

"""URL filter: longest matching rule first, else logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions; the regression is fitted on a small labelled table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table

#: The rules of the stated contract: verdict, and host with the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))

#: The labelled table: 1 is to be blocked.
LABELLED = (
    (1, "http://spam-farm.example/links/1"), (1, "https://www.link-farm.example/en/20"),
    (1, "http://cheap-pills.example/buy"), (1, "https://www.cheap-pills-online.example/en/order"),
    (1, "http://best-casino-bonus.example/win"), (1, "https://casino-slots.example/en/free"),
    (1, "http://free-money-now.example/click"), (1, "https://www.hot-singles.example/en/meet"),
    (1, "http://viagra-discount.example/en/1"), (1, "https://replica-watches.example/sale"),
    (1, "http://payday-loans-fast.example/apply"), (1, "https://click-bait.example/en/ads/7"),
    (1, "http://spam.example/en/55/"), (1, "https://pills-shop.example/de/4"), (1, "http://adult-cams.example/live"),
    (1, "https://www.farm-spam-links.example/fr/6"), (1, "http://win-prize-now.example/es/lottery"),
    (0, "https://www.library.example/en/20"), (0, "http://history-museum.example/visit"),
    (0, "https://blog.gardens.example/en/17.html"), (0, "http://m.weather.example/de/4"),
    (0, "https://news.example/world/2020/05/01"), (0, "https://www.university.example/courses/physics"),
    (0, "http://docs.software.example/guide/install"), (0, "https://recipes.example/en/bread"),
    (0, "http://thorin.example/en/341"), (0, "https://blog.renan.example/es/78"), (0, "https://www.theran.example/fr/5"),
    (0, "http://m.onthe.example/en/90?page=2"), (0, "https://tiona.example/de/12#top"),
    (0, "https://maps.example/city/river"), (0, "http://www.choir.example/songs/3"),
    (0, "https://theand.example/en/6"), (0, "http://blog.thernd.example/de/77"), (0, "https://m.ththou.example/en/2.html"),
    (0, "http://www.thatre.example/fr/18"), (0, "https://thing.example/en/404"), (0, "https://winter-sports.example/en/8"),
    (0, "http://tracking-birds.example/guide"), (0, "https://blog.adulteducation.example/courses"),
    (0, "https://www.farmers-market.example/es/3"), (0, "http://m.anthem.example/en/66"), (0, "https://lyon.example/fr/1"),
    (0, "https://forum.cycling.example/en/thread/9"), (0, "http://school.example/es/class/2"),
)

BUCKETS = 1024
GRAM = 3
BLOCK_AT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: str, path: str) -> Column:
    """Distinct buckets of the character n-grams of host and path; digits count as one character."""
    def of(mark: str, name: str) -> Column:
        text = F.concat(F.lit("^"), F.regexp_replace(name, "[0-9]+", "0"), F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
        return F.transform(places, lambda i: F.pmod(
            F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(GRAM))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(of("h", host), of("p", path)))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights by bucket and intercept from a small table of (label, url)."""
    host, path = split_url("url")
    grams = labelled.select("label", host.alias("host"), path.alias("path")).select(
        F.col("label").cast("double").alias("label"), gram_buckets("host", "path").alias("grams"))
    dense = grams.select("label", array_to_vector(F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.when(
            F.array_contains("grams", i), 1 / F.sqrt(F.size("grams"))).otherwise(F.lit(0.0)))).alias("features"))
    model = LogisticRegression(maxIter=40, regParam=0.0001, standardization=False, aggregationDepth=2).fit(
        dense.coalesce(1))
    return [float(w) for w in model.coefficients], float(model.intercept)


def judge_urls(pages: DataFrame, weights: list[float], intercept: float, key: str = "page_id", url: str = "url",
               rules=RULES) -> DataFrame:
    """Returns (key, host, path, rule, verdict, score) for each row.

    A null or unreadable url has an empty host and path, fits no rule and is judged by the model like
    any other. Rows are judged alone: repeated rows come out repeated, an empty table gives an empty one.
    """
    host, path = split_url("url")
    rule, verdict = rule_for("host", "path", rules)
    told = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select(
        "key", host.alias("host"), path.alias("path")).select(
        "key", "host", "path", rule.alias("rule"), verdict.alias("ruled"), gram_buckets("host", "path").alias("grams"))
    weight = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate("grams", F.lit(0.0), lambda sum_, i: sum_ + F.get(weight, i))
    score = 1 / (1 + F.exp(-(F.lit(intercept) + total / F.sqrt(F.size("grams")))))
    return told.withColumn("score", score).select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "score")


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = train(spark.createDataFrame(list(LABELLED), "label int, url string"))
    return judge_urls(table(spark, sf_dir, "pages"), weights, intercept)

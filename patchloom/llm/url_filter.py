"""URL verdicts: allow and block rules, then a logistic regression on hashed character n-grams.

Host and path are cut into character n-grams, each marked with the part it comes from
and hashed into a fixed number of places; the regression is trained from a small
labelled URL table. A rule fits its host and every subdomain where the path starts
with the rule's; the longest fitting rule decides, otherwise the regression does.

Null urls, and urls without ``://``, have an empty host and path; they fit no rule and
get the model's verdict on no n-grams. Repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
PLACES = 1 << 14


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, such as ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


RULES = (
    Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))

# Training table: unwanted and wanted first labels and sections, combined by labelled_urls.
DOMAINS = ("example.org", "example.com", "example.net")
UNWANTED_HOSTS = (
    "spam-farm", "ads-track", "click-ads", "best-casino", "free-pills", "win-prize", "adserver", "pop-track", "link-farm",
    "cheap-loans", "hot-dates", "track-pixel", "seo-spam", "banner-ads", "bonus-bet")
UNWANTED_SECTIONS = ("", "promo", "ad", "click", "out")
WANTED_HOSTS = (
    "news", "www.library", "blog.garden", "m.history", "wiki", "journal", "www.school", "museum", "recipes", "docs.science",
    "blog.music", "www.weather", "city-guide", "m.sport", "archive")
WANTED_SECTIONS = ("", "article", "en", "de", "story")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, label``: 1 for unwanted. Both kinds share domains and pages, so that only
    names and sections tell them apart."""
    sides = []
    for label, hosts, sections in ((1.0, UNWANTED_HOSTS, UNWANTED_SECTIONS), (0.0, WANTED_HOSTS, WANTED_SECTIONS)):
        side = spark.range(1).select(F.posexplode(F.array(*map(F.lit, hosts))).alias("k", "host"))
        side = side.select("k", "host", F.posexplode(F.array(*map(F.lit, sections))).alias("n", "section"))
        domain = F.get(F.array(*map(F.lit, DOMAINS)), F.col("k") + F.col("n") - F.floor((F.col("k") + F.col("n")) / 3).cast("int") * 3)
        page = (F.lit(37) * F.col("k") + F.col("n")).cast("string")
        slash = F.when(F.col("section") == "", "").otherwise("/")
        sides.append(side.select(
            F.concat(F.lit("https://"), "host", F.lit("."), domain, F.lit("/"), "section", slash, page).alias("url"),
            F.lit(label).alias("label")))
    return sides[0].unionByName(sides[1])


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(text, pattern, 2)


def _grams(mark: str, text: Column) -> list[Column]:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    out = []
    for size in SIZES:
        last = F.char_length(framed) - (size - 1)
        out.append(F.when(last >= 1, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i, n=size: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))).otherwise(F.array()))
    return out


def features(df: DataFrame, host: str, path: str) -> DataFrame:
    """Adds the hashed n-grams of the two columns as vector column ``_features``."""
    grams = F.array_distinct(F.concat(*_grams("h", F.col(host)), *_grams("p", F.col(path))))
    hashed = HashingTF(numFeatures=PLACES, inputCol="_grams", outputCol="_features", binary=True)
    return hashed.transform(df.withColumn("_grams", grams)).drop("_grams")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> LogisticRegressionModel:
    host, path = parts(url_col)
    rows = labelled.select(host.alias("_host"), path.alias("_path"), F.col(label_col).alias("label"))
    model = LogisticRegression(
        featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_block",
        regParam=0.01, maxIter=60, standardization=False)
    return model.fit(features(rows.coalesce(1), "_host", "_path"))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last, and so the longest, wins
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: tuple[Rule, ...] = RULES,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict``."""
    host, path = parts(url_col)
    cut = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    scored = model.transform(features(cut, "host", "path"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return scored.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(by_rule, F.when(F.col("_block") == 1.0, "block").otherwise("allow")).alias("verdict"))

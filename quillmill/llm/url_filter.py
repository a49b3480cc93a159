"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame expressions and the DataFrame-based ML library; no Python runs on executors. The model is fitted
on a fixed labelled table of some hundred URLs, so training does not grow with the input; judging is a narrow scan that
reads the url column alone and shuffles nothing.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the model
(whose features are then those of two empty strings). A very long url is judged whole, in time that grows with its length.
Repeated rows are judged alike. An empty table gives an empty result. Columns of the input other than the id and the url are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, values

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The labelled URLs: words of hosts, each given several forms by labelled_urls().
UNWANTED_HOSTS = (
    "casino-royal casino-spins lucky-casino win-jackpot bets-online sports-bets free-spins poker-win slots-free pills-store "
    "cheap-meds cheap-viagra diet-pills pharma-pills adult-cams adult-video xxx-clips x-adult spam-links link-spam seo-farm "
    "click-farm ads-server pop-ads ad-track track-clicks tracker-ads free-crypto-win payday-loans cheap-watches spam-mail"
).split()
WANTED_HOSTS = (
    "riverstone openlibrary cityschool greenfield northwind weathernotes mathworld gardenclub historyroom citynews "
    "healthguide cookingpages parkside theatre railnotes teacher theory another other interior thornton nation station "
    "motion ration thunder research museum poetry physics translation harbour village community science archive"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 is unwanted. Both classes get the same subdomains, endings and paths, so that only names tell."""
    rows = []
    for label, hosts in ((1.0, UNWANTED_HOSTS), (0.0, WANTED_HOSTS)):
        for i, host in enumerate(hosts):
            for j in range(3):
                sub = ("", "www.", "blog.", "m.")[(i + j) % 4]
                end = ("example.com", "example.net", "example.org", "com", "info")[(i + 2 * j) % 5]
                path = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/", "/index.html")[(2 * i + j) % 6].format(31 * i % 977)
                rows.append((f"http://{sub}{host}.{end}{path}", label))
    return values(spark, rows, "url, label")


def host_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; then up to ? or #."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host without a leading slash, then path) and its action; null if none does."""
    found = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, rule_host + rule_path).otherwise(found)
        action = F.when(fits, act).otherwise(action)
    return found, action


def ngrams(host: Column, path: Column, sizes: Sequence[int] = (3, 4)) -> Column:
    """Character n-grams, marked by where they come from; both strings get a mark at either end."""

    def of(mark: str, text: Column, n: int) -> Column:
        # a match takes one character and looks ahead for n, so that time grows with the text and not with its square
        grams = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
        return F.transform(grams, lambda g: F.concat(F.lit(mark), g))

    return F.array_distinct(F.concat(*(of(m, t, n) for m, t in (("h:", host), ("p:", path)) for n in sizes)))


def with_features(df: DataFrame, url: str) -> DataFrame:
    host, path = host_path(F.col(url))
    return df.withColumns({"host": host, "path": path}).withColumn("grams", ngrams(F.col("host"), F.col("path")))


def fit(labelled: DataFrame, buckets: int = 1 << 14, ridge: float = 0.001) -> PipelineModel:
    """labelled: url and label (1.0 unwanted), a small table: it is read once for each step of the optimiser."""
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True),
        LogisticRegression(regParam=ridge, maxIter=40, aggregationDepth=2),
    ]
    rows = with_features(labelled.select("url", "label"), "url").coalesce(1).persist()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, model: PipelineModel, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score (probability of being unwanted) of each page."""
    scored = model.transform(with_features(pages.select(F.col(id_col), F.col(url_col).alias("_url")), "_url"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return (
        scored.withColumn("score", vector_to_array("probability")[1])
        .select(id_col, "host", "path", rule.alias("rule"), F.coalesce(action, by_model).alias("verdict"), "score")
    )

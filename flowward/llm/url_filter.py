"""URL filter: fixed rules, and logistic regression on character n-grams of host and path for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules, verdict first.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: The labelled table a model is trained on unless another is given: unwanted hosts and paths, and plain ones.
UNWANTED = (
    "https://casino-win.example.org/en/1",
    "https://www.casino-bonus.example.com/spin",
    "http://best-casino.example.org/jackpot?ref=1",
    "http://online-poker.example.net/win",
    "https://poker-chips.example.com/bonus",
    "https://spam-farm.example.org/es/2",
    "http://spam-links.example.com/buy",
    "https://link-farm.example.org/en/seo",
    "http://farm-of-spam.example.com/fr/9",
    "https://cheap-pills.example.org/buy-now",
    "http://pills-online.example.com/order",
    "https://viagra-shop.example.net/cheap",
    "http://xxx-videos.example.com/free",
    "https://adult-cams.example.org/xxx",
    "https://free-porn.example.net/videos",
    "http://win-lottery.example.com/jackpot",
    "https://lottery-winner.example.org/claim",
    "http://fast-loans.example.com/apply-now",
    "https://payday-loan.example.org/cash",
    "http://malware-download.example.com/setup.exe",
    "https://cracked-software.example.org/keygen",
    "http://phishing-login.example.net/verify",
    "https://replica-watches.example.com/sale",
    "http://betting-tips.example.org/bet",
)
WANTED = (
    "https://blog.gardening.example.com/en/12",
    "http://www.library.example.org/catalogue",
    "https://news.example.com/fr/politique/3",
    "https://m.history.example.net/de/77",
    "http://museum.example.org/en/collections",
    "https://docs.example.com/guide/intro.html",
    "https://blog.travel.example.org/es/25",
    "http://university.example.net/courses/math",
    "https://www.recipes.example.com/bread",
    "https://weather.example.org/today",
    "http://theatre.example.com/en/programme",
    "https://m.thread.example.net/en/5",
    "https://science.example.org/articles/9",
    "http://www.thinkers.example.com/essays",
    "https://blog.mathematics.example.net/en/31",
    "https://health.example.org/advice/sleep",
    "http://council.example.com/services",
    "https://open-data.example.org/datasets",
    "https://www.schoolbooks.example.com/history",
    "http://birds.example.net/field-guide",
    "https://music.example.org/scores/bach",
    "https://blog.tion.example.com/en/853",
    "http://ththing.example.org/en/444",
    "https://www.therer.example.com/fr/604",
)


@dataclass(frozen=True)
class Settings:
    """N-grams of ``sizes`` characters in ``bins`` bins; urls of ``threshold`` or more are blocked."""

    sizes: tuple[int, ...] = (3, 4)
    bins: int = 1 << 14
    regularization: float = 0.003
    threshold: float = 0.5


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.regexp_extract(text, pattern, 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(text, pattern, 2)


def fitting_rule(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...] = RULES) -> F.Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def _letters(text: F.Column) -> F.Column:
    """The characters of a text between two marks."""
    return F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))


def _grams(letters: F.Column, mark: str, size: int) -> F.Column:
    places = F.sequence(F.lit(1), F.size(letters) - size + 1)
    grams = F.transform(places, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, F.lit(size)), "")))
    return F.when(F.size(letters) >= size, grams).otherwise(F.array().cast("array<string>"))


def with_features(urls: DataFrame, settings: Settings, host: str, path: str, to: str) -> DataFrame:
    """``urls`` with hashed counts of their n-grams; the numbers of a path say nothing and count as one."""
    flat = F.regexp_replace(path, "[0-9]+", "0")
    # exploded, so that the letters are there once a row and not worked out anew for every n-gram
    letters = F.struct(_letters(F.col(host)).alias("h"), _letters(flat).alias("p"))
    urls = urls.select("*", F.explode(F.array(letters)).alias(f"{to}_letters"))
    grams = [_grams(F.col(f"{to}_letters")[m], m, n) for n in settings.sizes for m in "hp"]
    hashed = HashingTF(numFeatures=settings.bins, inputCol=f"{to}_grams", outputCol=to, binary=True)
    urls = urls.withColumn(f"{to}_grams", F.concat(*grams))
    return hashed.transform(urls).drop(f"{to}_grams", f"{to}_letters")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, label)."""
    rows = [(u, 1.0) for u in UNWANTED] + [(u, 0.0) for u in WANTED]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {label}D)" for u, label in rows) + " AS t(url, label)")


def train(labelled: DataFrame, settings: Settings = Settings(), max_rows: int = 100_000) -> LogisticRegressionModel:
    """A model of a small labelled table; of a larger one, the ``max_rows`` rows first by hash are used."""
    host, path = host_and_path()
    rows = labelled.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(max_rows)
    rows = rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    rows = with_features(rows, settings, "host", "path", "features")
    return LogisticRegression(regParam=settings.regularization, maxIter=50).fit(rows)


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    settings: Settings = Settings(),
    rules: tuple[tuple[str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the longest rule's verdict, else the model's.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model (it has
    no n-grams but the empty ones). Repeated rows are judged alike; null ids stay null; other columns are not read.
    """
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession), settings)
    host, path = host_and_path(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = with_features(urls, settings, "host", "path", "features")
    scored = model.transform(urls).withColumn("score", F.get(vector_to_array("probability"), 1))
    scored = scored.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    learnt = F.when(F.col("score") >= settings.threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learnt).alias("verdict"), "score"
    )

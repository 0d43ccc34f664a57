"""Operator 3, URL filters: host-suffix and path-prefix expressions against hashed rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, others, written

#: (host, path, verdict); the rule's text is host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Rules held as a Python list are at most so many; only such a list is broadcast.
MOST_LISTED_RULES = 100_000

NUL = "\x00"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(NUL), path), 256)


def _directory(path: Column) -> Column:
    """A rule path up to its last slash: what a URL's expressions are looked up by."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow", salts: int = 16) -> DataFrame:
    """pages with host, path, rule and verdict.

    Each distinct URL is judged once: it becomes its host suffixes, each with its path's directory prefixes (as many
    labels and directories as any rule has), which meet the rules on the first 32 bits of a digest; the full digest is
    then compared, and of the rules that are left the longest wins (then the longer host, then block). A rule whose
    path doesn't end in a slash is met at its directory and compared in full. URLs without a rule get `default`.

    Rules given as a list are broadcast (at most MOST_LISTED_RULES); those given as a DataFrame (host, path, verdict)
    meet the expressions in a shuffled join over `salts` parts of each prefix. URLs are distinct before that, so a URL
    in a third of the rows is one row per task.

    Defined cases: a null URL or one without `://` has an empty host and path and no rule; repeated rows and null ids
    stay; a very long URL has no more expressions than the rules have labels and directories, so its work is in proportion
    to its length; an empty table gives an empty one; a rule listed twice counts once, with block before allow; null rules never fit; columns of pages
    named as the results are left out.
    """
    spark = pages.sparkSession
    listed = not isinstance(rules, DataFrame)
    if listed:
        if len(rules) > MOST_LISTED_RULES:
            raise ValueError(f"{len(rules)} rules; give more than {MOST_LISTED_RULES} as a DataFrame")
        rules = spark.createDataFrame(list(rules), T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")]))
    book = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    book = book.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # of allow and block the larger is block
    book = book.withColumn("r_dir", _directory(F.col("r_path")))
    most = book.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"), F.max(F.size(F.split("r_dir", "/")) - 1).alias("dirs")).first()
    labels, dirs = most["labels"] or 1, most["dirs"] or 0
    book = book.withColumn("full", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring(_digest(F.col("r_host"), F.col("r_dir")), 1, 8))

    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    parts, steps = F.split("_host", r"\."), F.split("_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(dirs))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))))
    expressions = (
        urls.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_prefix", F.explode(prefixes))
        .withColumn("prefix", F.substring(_digest(F.col("_suffix"), F.col("_prefix")), 1, 8))
        .select("_url", "_path", "_suffix", "_prefix", "prefix")
    )
    if listed:
        met = expressions.join(F.broadcast(book), "prefix")
    else:
        salted = book.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("_url"), F.lit(salts)).cast("int")).join(salted, ["prefix", "salt"])
    fits = met.where((F.col("_prefix") == F.col("r_dir")) & (_digest(F.col("_suffix"), F.substring(F.col("_path"), F.lit(1), F.length("r_path"))) == F.col("full")))
    best = fits.groupBy("_url").agg(
        F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))).alias("_best")
    )
    # Both sides come straight from a shuffle, so that adaptive execution can split a URL, or null, of very many rows.
    best = written(best, "judged-urls")
    return pages.join(best, pages[url_col] == best["_url"], "left").select(
        *[pages[c] for c in others(pages, "host", "path", "rule", "verdict")],
        host_of(pages[url_col]).alias("host"),
        path_of(pages[url_col]).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.v"), F.lit(default)).alias("verdict"),
    )

"""Operator 7, secret scans: candidates by pattern, judged by how many owners hold the same value."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_ID, others, with_row_id, written


class Kind(NamedTuple):
    """A pattern, the group that holds the value, its fewest characters, and a cheap test that any match passes."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    test: str = ""
    base: bool = False


KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)passw|secret|token|api_?key", True),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}", True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}", True),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, r"xox[abprs]-"),
    # Only where a run of its characters begins: else each eyJ of a long run would look through the rest of it.
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, r"eyJ[A-Za-z0-9_-]{8}"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN "),
)

#: A value is an example if so many owners hold it; or if more than one do, in so many repositories together.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 10

#: A code point that stands for no character.
MARK = "\ufdd0"


def _matches(text: Column, no: int, kind: Kind) -> Column:
    """The leftmost non-overlapping matches in order, each with the length of the text before it since the last one.

    Matches are set off by a mark and the text is split there, in time in proportion to it. A mark in the text itself is
    first replaced by another character that no pattern takes.
    """
    marked = F.regexp_replace(F.translate(text, MARK, "\ufffd"), kind.pattern, f"{MARK}$0{MARK}")
    value = lambda m: F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m

    def each(parts: Column) -> Column:
        def one(i: Column) -> Column:
            m = F.get(parts, 2 * i + 1)
            v = value(m)
            return F.struct(F.lit(no).alias("kind"), i.alias("i"), F.length(F.get(parts, 2 * i)).alias("gap"), F.length(m).alias("n"), F.length(v).alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"))

        n = ((F.size(parts) - 1) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))

    each = F.transform(F.array(F.split(marked, MARK, -1)), each)[0]
    return F.when(text.rlike(kind.test), each).otherwise(F.lit(None))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """docs without the text, with spans (array of kind, start, end, owners, repositories, verdict), by start, then kind.

    Matches are found row by row. A match's place is the running sum of the lengths before it, a window within the
    row's own matches. Values travel as 128-bit hashes: for each, its repositories (ids) are made distinct, then
    counted by owner, then summed, so that a value copied into a third of the corpus is spread by repository first and
    is one row per task after. A value that at least `shared_owners` owners hold is an `example`, and so is one of several
    owners in at least `shared_repositories` repositories; all others, those of one owner in whatever number of its
    repositories among them, are `live`. Only values of several repositories meet the spans again, from a written table,
    so that a hot one is split. Texts are never shuffled.

    Defined cases: null text has no spans; rows with one id are one repository but keep their own spans; null ids are
    one repository and null owners one owner; a very long text is searched whole, by patterns that take time in proportion
    to it; an empty table gives an empty one; other columns pass through, but for spans.
    """
    rows = with_row_id(docs)
    text = F.col(text_col)
    matched = rows.select(ROW_ID, F.col(id_col).alias("_repo"), F.col(owner_col).alias("_owner"), F.explode(F.array(*[_matches(text, no, k) for no, k in enumerate(KINDS)])).alias("_list"))
    matched = matched.select(ROW_ID, "_repo", "_owner", F.explode("_list").alias("_m")).select(ROW_ID, "_repo", "_owner", "_m.*")
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    end = F.sum((F.col("gap") + F.col("n")).cast("long")).over(Window.partitionBy(ROW_ID, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = matched.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where(F.col("v") >= least)
    spans = written(spans.select(ROW_ID, "_repo", "_owner", "kind", "start", "end", "h1", "h2"), "secrets")

    held = spans.groupBy("h1", "h2", "_owner", "_repo").agg(F.lit(1).alias("one")).groupBy("h1", "h2", "_owner").agg(F.count("*").alias("r"))
    held = held.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    held = written(held.where("repositories > 1"), "values")
    judged = spans.join(held, ["h1", "h2"], "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("owners", "repositories")})
    copied = (F.col("owners") >= shared_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= shared_repositories))
    judged = judged.withColumn("verdict", F.when(copied, "example").otherwise("live"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = F.struct("start", "kind", "end", F.element_at(names, F.col("kind") + 1).alias("name"), "owners", "repositories", "verdict")
    listed = judged.groupBy(F.col(ROW_ID).alias("_row")).agg(F.array_sort(F.collect_list(one)).alias("spans"))
    empty = F.array().cast(listed.schema["spans"].dataType)
    kept = others(docs, text_col, "spans")
    return rows.select(ROW_ID, *kept).join(listed, F.col(ROW_ID) == F.col("_row"), "left").select(*kept, F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")

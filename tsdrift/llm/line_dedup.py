"""Line dedup by site-relative frequency.

Pages are grouped by host.  A line (trimmed, with at least one word) is
boilerplate of a host when it stands on at least ``min_pages`` pages of that
host and on more than ``ratio`` of all its pages; every occurrence of it on
that host is dropped.  A line is counted once per page, and pages with equal text
count once, so copies of a page do not make its lines boilerplate.

Counting is map-side combined, per (host, text hash) first and per (host, line
hash) then, so a host with a third of all pages, a page of a thousand copies or a
line on all pages costs each task one row.  What is joined back is one array of line
hashes per host, fewer than (lines per page) / ratio.

Defined cases: a null host is a host of its own; a null text stays null, an
empty one empty, and each counts as one page of its host; repeated rows are one
page and get the same result; blank lines are kept; a line on
exactly the ratio of the pages stays; an empty table gives an empty table; a very
long text is split whole.  All columns of the input stay, whatever their names,
but one named ``dropped_lines`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsdrift.llm.common import SPACE, SPACE_CLASS, content_key, unused
from tsdrift.session import materialize

RATIO = 0.01
MIN_PAGES = 5


def line_hash(line: Column) -> Column:
    """Hash of the trimmed line; 128 bits, as hosts are large."""
    x = F.btrim(line, F.lit(SPACE))
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def page_lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """One row per host and different text with the distinct hashes of its lines."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    pages = docs.select(F.col(host).alias("host"), *content_key(text), F.array_distinct(F.transform(lines, line_hash)).alias("lines"))
    return pages.groupBy("host", "key_a", "key_b").agg(F.first("lines").alias("lines")).select("host", "lines")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (hash), pages and host_pages of every boilerplate line."""
    each = page_lines(docs, host, text)
    marked = each.select("host", F.explode(F.concat(
        F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), "lines")).alias("line"))
    counts = marked.groupBy("host", "line.a", "line.b").agg(F.count("*").alias("pages"))
    lines = counts.where(F.col("a").isNotNull() & (F.col("pages") >= min_pages))
    totals = counts.where(F.col("a").isNull()).select(F.col("host").alias("h"), F.col("pages").alias("host_pages"))
    return lines.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(
        F.col("pages") > F.col("host_pages") * F.lit(ratio)).select(
        "host", F.struct("a", "b").alias("line"), "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus
    ``dropped_lines``.

    That table of hashes per host is written first: the
    planner knows its size and broadcasts it only if that is below the
    session's limit; otherwise the host join shuffles, and its hot partitions
    are split at run time."""
    of, bad, all_, kept = unused(docs.columns, "__host", "__bad", "__lines", "__kept")
    per_host = materialize(boilerplate(docs, host, text, ratio, min_pages).groupBy(
        F.col("host").alias(of)).agg(F.collect_list("line").alias(bad)), "boilerplate")
    joined = docs.join(per_host, F.col(host).eqNullSafe(F.col(of)), "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    parts = F.split(F.col(text), "\n")
    staged = joined.withColumn(bad, F.coalesce(bad, none)).withColumn(all_, F.when(
        F.size(bad) > 0, parts)).withColumn(kept, F.filter(
            all_, lambda x: ~F.array_contains(F.col(bad), line_hash(x))))
    cut = F.size(kept) < F.size(all_)
    columns = [F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`")
               for c in docs.columns if c.lower() != "dropped_lines"]
    dropped = F.when(cut, F.size(all_) - F.size(kept)).otherwise(0).cast("long")
    return staged.select(*columns, dropped.alias("dropped_lines"))

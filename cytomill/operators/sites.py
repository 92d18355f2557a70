"""Cutting sites: per strand and fragment length the half-open range of positions that is kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

COLUMNS = ("bs_strand", "flen", "start", "end")


def check(sites: DataFrame) -> DataFrame:
    if tuple(sites.columns) != COLUMNS:
        raise ValueError(f"cutting sites need the columns {COLUMNS}, not {sites.columns}")
    return sites


def from_fragment_ends(spark: SparkSession, spec: Mapping[str, tuple[int, int]], max_read_length: int) -> DataFrame:
    """Sites that cut fixed numbers of letters at both fragment ends: ``spec`` has (start, end) for each strand."""
    if set(spec) != set(C.STRANDS):
        raise ValueError(f"the specification needs exactly the strands {C.STRANDS}")
    max_flen = max_read_length + max(e for _, e in spec.values())
    strands = F.explode(F.array(*[F.struct(F.lit(s).alias("bs_strand"), F.lit(spec[s][0]).cast("long").alias("a"), F.lit(spec[s][1]).cast("long").alias("b")) for s in C.STRANDS]))
    df = spark.range(max_flen + 1).select(F.col("id").alias("flen"), strands.alias("s")).select("flen", "s.*")
    end = F.least(F.col("flen") - F.col("b"), F.lit(max_read_length))
    empty = F.col("a") >= end
    return df.select("bs_strand", "flen", F.when(empty, 0).otherwise(F.col("a")).cast("long").alias("start"), F.when(empty, 0).otherwise(end).cast("long").alias("end"))


def dense(sites: DataFrame) -> DataFrame:
    """A row for every length from the smallest to the largest, gaps filled from the next larger length.
    Below the smallest there is none, so everything is trimmed there."""
    ends = sites.agg(F.min("flen").alias("lo"), F.max("flen").alias("hi"))
    strands = F.broadcast(sites.where(F.col("bs_strand").isin(*C.STRANDS)).select("bs_strand").distinct())  # four rows at most
    grid = ends.select(F.explode(F.sequence("lo", "hi")).alias("flen")).join(strands)
    w = Window.partitionBy("bs_strand").orderBy("flen").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = grid.join(sites, ["bs_strand", "flen"], "left")
    return full.select("bs_strand", "flen", *[F.coalesce(F.first(c, ignorenulls=True).over(w), F.lit(0)).cast("long").alias(c) for c in ("start", "end")])


def unique_mode(values: Column) -> Column:
    """The most frequent value if it is unique, comes at least three times, and there are three values at least; else null."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    top = F.array_max(counts)["n"]
    best = F.filter(counts, lambda x: x["n"] == top)
    return F.when((F.size(values) >= 3) & (top >= 3) & (F.size(best) == 1), F.get(best, F.lit(0))["v"])


def smoothed(sites: DataFrame, reach: int = 10) -> DataFrame:
    """Replace a site by its neighbours' value where the unique modes of the ``reach`` shorter and longer
    lengths agree; start and end independently. A window is a fixed number of rows per strand."""
    w = Window.partitionBy("bs_strand").orderBy("flen")
    left, right = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    out = sites
    for c in ("start", "end"):
        out = out.withColumns({f"_l{c}": F.collect_list(c).over(left), f"_r{c}": F.collect_list(c).over(right)})
    for c in ("start", "end"):
        a, b = unique_mode(F.col(f"_l{c}")), unique_mode(F.col(f"_r{c}"))
        out = out.withColumn(c, F.when(a == b, a).otherwise(F.col(c)))
    return out.select(*sites.columns)


def least_length(sites: DataFrame, min_length: int) -> DataFrame:
    """Ranges shorter than ``min_length`` become empty."""
    short = F.col("end") - F.col("start") < min_length
    return sites.withColumns({c: F.when(short, 0).otherwise(F.col(c)).cast("long") for c in ("start", "end")})


def plot_table(sites: DataFrame) -> DataFrame:
    """Long form for a line chart: ``cut_end`` (start or end) and ``cut_pos``; by motif too if there is one."""
    return sites.unpivot([c for c in ("motif", "bs_strand", "flen") if c in sites.columns], ["start", "end"], "cut_end", "cut_pos")

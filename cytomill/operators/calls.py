"""Methylation calls per position, strand merging and coverage histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

POSITION = ("chrom", "start", "motif")


def _sums(prefix: str, where: Column) -> list[Column]:
    meth, seen = F.col("status") == C.METH, F.col("status").isin(C.METH, C.UNMETH)
    return [F.coalesce(F.sum((where & meth).cast("long")), F.lit(0)).alias(f"{prefix}n_meth"), F.coalesce(F.sum((where & seen).cast("long")), F.lit(0)).alias(f"{prefix}n_total")]


def call(reads: DataFrame, position: Sequence[str] = POSITION) -> DataFrame:
    """``n_meth``, ``n_total`` and ``beta_value`` per position; rows marked by ``overlap`` count once."""
    out = reads.groupBy(*position).agg(*_sums("", ~F.col("overlap")))
    return out.withColumn("beta_value", C.ratio(F.col("n_meth"), F.col("n_total")))


def stratified_call(reads: DataFrame, position: Sequence[str] = POSITION) -> DataFrame:
    """The same for all reads and for each strand and mate; within strands and mates overlapping reads count."""
    aggs = _sums("", ~F.col("overlap"))
    for s in C.STRANDS:
        aggs += _sums(f"{s}_", F.col("bs_strand") == s)
    for name, first in (("mate1", True), ("mate2", False)):
        aggs += _sums(f"{name}_", F.col("is_read1") == F.lit(first))
    out = reads.groupBy(*position).agg(*aggs)
    return out.withColumns({f"{p}beta_value": C.ratio(F.col(f"{p}n_meth"), F.col(f"{p}n_total")) for p in ("", *[f"{s}_" for s in C.STRATA])})


def with_all_positions(index: DataFrame, called: DataFrame, position: Sequence[str] = POSITION) -> DataFrame:
    """The calls of every index position; those without reads have counts of 0 and a null beta."""
    counts = [c for c in called.columns if c.endswith(("n_meth", "n_total"))]
    return index.join(called, list(position), "left").fillna(0, counts)


def merge_strands(called: DataFrame) -> DataFrame:
    """Sum the calls of the two cytosines of a CG by position: the minus strand's lies one letter on."""
    key = F.col("start") - F.when(F.col("strand") == "-", 1).otherwise(0)
    rest = [c for c in called.columns if c not in ("chrom", "start", "end", "strand") and not c.endswith(("n_meth", "n_total", "beta_value"))]
    return _merged(called.withColumn("_key", key), ["chrom", "_key"], F.struct(F.col("start"), F.col("strand")), rest, called.columns)


#: Letters of a stretch whose lines are numbered by one task.
STRETCH = 1 << 20


def line_numbers(called: DataFrame, order: Sequence[str | Column], by: Sequence[str]) -> DataFrame:
    """``called`` with ``_n``, the number of a row within ``by`` in ``order``, from 0. Where ``order`` begins with contig and
    start, stretches of contigs are counted first and numbered in parallel; a stretch's offset comes from the small table of counts."""
    if list(order[:2]) != ["chrom", "start"]:
        return called.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    cut = called.withColumn("_at", F.floor(F.col("start") / STRETCH))
    counts = cut.groupBy(*by, "chrom", "_at").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("chrom", "_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "chrom", "_at", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*by, "chrom", "_at").orderBy(*order[1:])) - 1
    return cut.join(counts, [*by, "chrom", "_at"]).withColumn("_n", nth + F.col("_before")).drop("_at", "_before")


def merge_lines(called: DataFrame, order: Sequence[str | Column] = ("chrom", "start", "strand"), by: Sequence[str] = ("motif",)) -> DataFrame:
    """Sum consecutive rows, first and second, third and fourth and so on, within each ``by``, whatever they
    are; an odd last row is dropped. ``start`` and other columns come from the first row, ``end`` from the second."""
    rows = line_numbers(called, order, by).withColumn("_key", F.floor(F.col("_n") / 2))
    rest = [c for c in called.columns if c not in ("start", "end", *by) and not c.endswith(("n_meth", "n_total", "beta_value"))]
    return _merged(rows, [*by, "_key"], F.col("_n"), rest, called.columns, lines=2)


def _merged(rows: DataFrame, keys: list[str], order: Column, rest: list[str], columns: list[str], lines: int | None = None) -> DataFrame:
    stats = [c[: -len("n_total")] for c in columns if c.endswith("n_total")]
    first = [F.min_by(c, order).alias(c) for c in rest if c not in keys]
    if "strand" in columns and "strand" not in rest and "strand" not in keys:
        first.append(F.min_by("strand", order).alias("strand"))
    sums = [F.sum(f"{p}{c}").cast("long").alias(f"{p}{c}") for p in stats for c in ("n_meth", "n_total")]
    out = rows.groupBy(*keys).agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), *first, *sums, F.count("*").alias("_lines"))
    if lines is not None:
        out = out.where(F.col("_lines") == lines)
    out = out.withColumns({f"{p}beta_value": C.ratio(F.col(f"{p}n_meth"), F.col(f"{p}n_total")) for p in stats})
    return out.select(*[c for c in columns if c in out.columns])


def coverage_histogram(called: DataFrame, max_coverage: int, motifs: Sequence[str] = C.MOTIFS) -> DataFrame:
    """``counts`` of positions per motif and coverage, dense from 0 to ``max_coverage``, higher ones pooled there."""
    spark = called.sparkSession
    counts = called.groupBy("motif", F.least("n_total", F.lit(max_coverage)).cast("long").alias("coverage")).agg(F.count("*").alias("counts"))
    levels = spark.range(max_coverage + 1).select(F.col("id").alias("coverage"), F.explode(F.array(*map(F.lit, motifs))).alias("motif"))
    return F.broadcast(levels).join(counts, ["motif", "coverage"], "left").select("motif", "coverage", F.coalesce("counts", F.lit(0)).alias("counts"))

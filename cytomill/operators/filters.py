"""Read filters in their fixed order: mapping quality, trimming, mate overlap, base quality.

They take rows of ``pileup_reads``. Mapping quality and trimming drop rows; the overlap step sees bases of
low quality and other statuses too and marks rows; base quality comes last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .pileup import ALONE, CELL

#: Full order of reads at a position; inputs without a file order name columns that tell rows apart.
FILE_ORDER = ("file_ord",)


def mapq_filter(reads: DataFrame, min_mapq: int) -> DataFrame:
    return reads.where(F.col("mapq") >= min_mapq)


def phred_filter(reads: DataFrame, min_phred: int) -> DataFrame:
    return reads.where(F.col("phred") >= min_phred)


def trim(reads: DataFrame, sites: DataFrame, max_flen: int) -> DataFrame:
    """Keep bases within the cutting sites of their strand and fragment length. ``sites`` is dense in
    flen (see ``sites.dense``); of the rows for one strand and length the first counts. There are four strands and
    ``max_flen`` lengths at most, so it is broadcast; longer fragments count as ``max_flen``, missing sites trim everything."""
    s = sites.where(F.col("flen").between(0, max_flen) & F.col("bs_strand").isin(*C.STRANDS)).dropDuplicates(["bs_strand", "flen"]).select("bs_strand", F.col("flen").alias("_flen"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    flen = F.least(F.abs("tlen"), F.lit(max_flen))
    joined = reads.withColumn("_flen", flen.cast("long")).join(F.broadcast(s.withColumn("_flen", F.col("_flen").cast("long"))), ["bs_strand", "_flen"])
    return joined.where((F.col("_from") <= F.col("pos_in_read")) & (F.col("pos_in_read") < F.col("_to"))).drop("_flen", "_from", "_to")


def lone(reads: DataFrame, position: Sequence[str], name: str) -> bool:
    """Whether rows say if they are ALONE, and of groups no wider than that was told for."""
    return ALONE in reads.columns and name == "read_name" and {"chrom", "start"} <= set(position)


def overlap(reads: DataFrame, position: Sequence[str] = ("chrom", "start"), order: Sequence[str | Column] = FILE_ORDER, name: str = "read_name") -> DataFrame:
    """Mates at one position: pairs that disagree are dropped; of pairs that agree, the one of lower
    quality (of equals, the later) gets ``overlap`` = true. Only groups of exactly two count. Rows of
    status NA take no part and are dropped. Rows of ``pileup_reads`` bring their cells, by which the join has dealt them
    already, so their bases are not shuffled again; those that are ALONE need no window."""
    if lone(reads, position, name):
        rest = overlap(reads.where(~F.col(ALONE)).drop(ALONE), position, order, name)
        return reads.where(F.col(ALONE) & (F.col("status") != C.NA)).drop(ALONE).withColumn("overlap", F.lit(False)).unionByName(rest)
    cell = [c for c in CELL if c in reads.columns]  # they follow from position and name: rows of the pileup's join stay where they are
    w = Window.partitionBy(*cell, *position, name)
    ranked = w.orderBy(F.col("phred").desc(), *order)
    r = reads.where(F.col("status") != C.NA).withColumns({"_n": F.count("*").over(w), "_lo": F.min("status").over(w), "_hi": F.max("status").over(w), "_k": F.row_number().over(ranked)})
    pair = F.col("_n") == 2
    r = r.where(~(pair & (F.col("_lo") != F.col("_hi"))))
    return r.withColumn("overlap", pair & (F.col("_k") == 2)).drop("_n", "_lo", "_hi", "_k")


def marked(reads: DataFrame, sites: DataFrame | None = None, max_flen: int = 0, min_mapq: int = 0, min_phred: int = 0, position: Sequence[str] = ("chrom", "start"), order: Sequence[str | Column] = FILE_ORDER, name: str = "read_name") -> DataFrame:
    """All rows, with ``called``, whether ``filtered`` would keep the row, and ``overlap`` as it marks it: for counters that want other rows
    as well. Rows that mapping quality or trimming leave out take no part in their mates' comparison, as there."""
    used = (F.col("mapq") >= min_mapq) & (F.col("status") != C.NA)
    reads = reads.drop(ALONE)  # lone bases apart would be a second scan of the reads
    own = reads.columns
    if sites is not None:
        s = sites.where(F.col("flen").between(0, max_flen) & F.col("bs_strand").isin(*C.STRANDS)).dropDuplicates(["bs_strand", "flen"])
        s = s.select("bs_strand", F.col("flen").cast("long").alias("_flen"), F.col("start").alias("_from"), F.col("end").alias("_to"))
        reads = reads.withColumn("_flen", F.least(F.abs("tlen"), F.lit(max_flen)).cast("long")).join(F.broadcast(s), ["bs_strand", "_flen"], "left")
        used &= F.coalesce((F.col("_from") <= F.col("pos_in_read")) & (F.col("pos_in_read") < F.col("_to")), F.lit(False))
    r = reads.withColumn("_used", used)
    w = Window.partitionBy(*[c for c in CELL if c in own], *position, name, "_used")
    r = r.withColumns({"_n": F.count("*").over(w), "_lo": F.min("status").over(w), "_hi": F.max("status").over(w), "_k": F.row_number().over(w.orderBy(F.col("phred").desc(), *order))})
    pair = F.col("_used") & (F.col("_n") == 2)
    called = F.col("_used") & ~(pair & (F.col("_lo") != F.col("_hi"))) & (F.col("phred") >= min_phred)
    return r.select(*own, called.alias("called"), (pair & (F.col("_k") == 2)).alias("overlap"))


def filtered(reads: DataFrame, sites: DataFrame | None = None, max_flen: int = 0, min_mapq: int = 0, min_phred: int = 0, **kw) -> DataFrame:
    """All four steps."""
    reads = mapq_filter(reads, min_mapq)
    if sites is not None:
        reads = trim(reads, sites, max_flen)
    return phred_filter(overlap(reads, **kw), min_phred)

"""SAM text, and BAM by ``bam``, with the same columns: qname, flag, rname, pos (0-based), mapq, cigar, tlen,
seq, qual (text with offset 33) and ``file_ord``, which sorts reads as in the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bam
from .bam import SCHEMA  # noqa: F401


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text in splits, without Python. ``file_ord`` is the split's offset and the row's place in it."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"))
    parts = F.split("value", "\t")
    f = [F.get(parts, F.lit(i)) for i in range(11)]  # header lines have fewer
    order = F.col("_at") + F.col("_n").bitwiseAND((1 << 33) - 1)
    return t.where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(
        f[0].alias("qname"), f[1].try_cast("int").alias("flag"), f[2].alias("rname"), (f[3].try_cast("long") - 1).alias("pos"), f[4].try_cast("int").alias("mapq"),
        f[5].alias("cigar"), f[8].try_cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), order.alias("file_ord"),
    )


def read(spark: SparkSession, path: str, contigs: Sequence[str] | None = None) -> DataFrame:
    """Reads of a SAM or BAM file, of ``contigs`` only if given: of a BAM file with an index, only their chunks are opened."""
    df = bam.read(spark, path) if path.endswith(".bam") else read_sam(spark, path)
    return df if contigs is None else df.where(F.col("rname").isin(*contigs))

"""BED-like tables with a header line: indexes and methylation calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that identify a position; all others of a call file are numbers by their name.
INDEX_COLUMNS = ("chrom", "start", "end", "motif", "score", "strand", "triplet_seq", "seq_context")


def kind(name: str) -> str:
    """Type of a column by its name."""
    if name in ("start", "end"):
        return "long"
    if any(k in name for k in ("n_meth", "n_unmeth", "n_total")):
        return "long"
    return "double" if "beta_value" in name else "string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose first line begins with ``#``; plain or gzip; ``nan`` is null."""
    df = spark.read.csv(path, sep="\t", header=True, nullValue="nan")
    if not df.columns or not df.columns[0].startswith("#"):
        raise ValueError(f"{path} needs a header line that begins with #")
    names = [df.columns[0].lstrip("#"), *df.columns[1:]]
    names = ["chrom" if n == "chr" else n for n in names]
    return df.toDF(*names).select(*[F.col(n).cast(kind(n)).alias(n) for n in names])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    df = read(spark, path)
    return df.withColumn("watson_base", F.when(F.col("strand") == "+", "C").otherwise("G"))

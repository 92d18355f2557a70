"""Positional bias statistics: the count cube, its roll-ups, masks and quality thresholds.

The cube is sparse; ``densify`` fills the levels only where an operator depends on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

CUBE = ("seq_context", "bs_strand", "flen", "phred", "pos")
INDEX = ("motif", "seq_context", "mate", "bs_strand", "flen", "phred", "pos")


@dataclass(frozen=True)
class Binning:
    """Levels of the binned dimensions."""

    context_size: int = 5
    max_single_flen: int = 150
    flen_width: int = 20
    max_flen: int = 500
    phred_width: int = 5
    max_phred: int = 40


def cell(b: Binning = Binning(), context: str = "seq_context") -> tuple[dict[str, Column], Column]:
    """The cell of a row, by name, and whether the row is counted: METH or UNMETH, on a strand, in a defined context."""
    keys = {
        "seq_context": C.pooled(F.col(context)), "bs_strand": F.col("bs_strand"),
        "flen": C.flen_bin(F.col("tlen"), b.max_single_flen, b.flen_width, b.max_flen), "phred": C.phred_bin(F.col("phred"), b.phred_width, b.max_phred),
        "pos": (F.col("pos_in_read") + 1).cast("long"), "meth_status": F.when(F.col("status") == C.METH, "n_meth").otherwise("n_unmeth"),
    }
    return keys, F.col("status").isin(C.METH, C.UNMETH) & F.col("bs_strand").isNotNull() & C.context_ok(F.col(context), b.context_size)


def count_cube(reads: DataFrame, b: Binning = Binning(), context: str = "seq_context") -> DataFrame:
    """Counts by context, strand, fragment length, quality, position (from 1) and status. Quality,
    trimming and overlap filters do not apply here; only METH and UNMETH of defined contexts count.

    Both statuses of a cell are counted in one row and told apart afterwards, so the rows stay dealt by cell and ``stats``
    needs no further shuffle."""
    keys, counted = cell(b, context)
    r = reads.where(counted).select(*[v.alias(k) for k, v in keys.items()])
    kinds = ("n_meth", "n_unmeth")
    both = r.groupBy(*CUBE).agg(*[F.count_if(F.col("meth_status") == k).alias(k) for k in kinds])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("meth_status"), F.col(k).alias("counts")) for k in kinds]))
    return both.select(*CUBE, each).where("counts > 0")


def densify(df: DataFrame, levels: dict[str, DataFrame], value: Sequence[str] = ("counts",)) -> DataFrame:
    """``df`` over the full product of ``levels`` (a one-column frame per dimension, few rows each, broadcast);
    missing values become 0."""
    grid = reduce(lambda a, c: a.join(F.broadcast(c)), levels.values())
    return grid.join(df, list(levels), "left").fillna(0, list(value))


def possible(df: DataFrame) -> DataFrame:
    """Drop positions that a fragment of that length cannot have; the last one goes too."""
    return df.where(F.col("flen") - 1 >= F.col("pos"))


def with_beta(df: DataFrame) -> DataFrame:
    return df.withColumn("beta_value", C.ratio(F.col("n_meth"), F.col("n_meth") + F.col("n_unmeth")))


def stats(cube: DataFrame, context_size: int = 5, classical: bool = True) -> DataFrame:
    """``n_meth``, ``n_unmeth`` and beta by motif, context, mate, strand, fragment length, quality and position."""
    s = possible(cube).groupBy(*CUBE).agg(*[F.coalesce(F.sum(F.when(F.col("meth_status") == m, F.col("counts"))), F.lit(0)).cast("long").alias(m) for m in ("n_meth", "n_unmeth")])
    s = s.withColumns({"motif": C.motif_of_context(F.col("seq_context"), context_size, classical), "mate": C.mate_label(F.col("bs_strand"))})
    return with_beta(s).select(*INDEX, "n_meth", "n_unmeth", "beta_value")


def ordered(df: DataFrame) -> DataFrame:
    """Sorted by motif, context, mate, strand by its ordinal, and numbers: the order of tables that people read."""
    keys = [C.strand_rank(F.col(c)) if c == "bs_strand" else F.col(c) for c in INDEX if c in df.columns]
    return df.orderBy(*keys)


def used_phred(df: DataFrame) -> DataFrame:
    """Only quality levels that were seen anywhere."""
    used = df.groupBy("phred").agg(F.sum(F.col("n_meth") + F.col("n_unmeth")).alias("n")).where("n > 0").select("phred")
    return df.join(used, "phred", "left_semi")


def roll_up(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums by ``keys``, masked rows counting 0, and beta."""
    return with_beta(df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_meth", "n_unmeth")]))


def classic(df: DataFrame) -> DataFrame:
    return possible(roll_up(df, ("motif", "bs_strand", "flen", "pos")))


def masked(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Null the numbers outside the cutting sites (0-based, half-open, against positions from 1). A stratum
    without a site is an error when the rows are read. Spark broadcasts the sites if their size allows it."""
    s = sites.select("bs_strand", "flen", F.col("start").alias("_from"), F.col("end").alias("_to"))
    joined = df.join(s, ["bs_strand", "flen"], "left")
    missing = F.raise_error(F.concat(F.lit("no cutting site for "), F.col("bs_strand"), F.lit(" "), F.col("flen").cast("string"))).cast("boolean")
    inside = F.when(F.col("_from").isNull(), missing).otherwise((F.col("_from") + 1 <= F.col("pos")) & (F.col("pos") <= F.col("_to")))
    return joined.withColumns({c: F.when(inside, F.col(c)) for c in ("n_meth", "n_unmeth", "beta_value")}).select(*df.columns)


def phred_thresholds(df: DataFrame, motif: str = "CG") -> DataFrame:
    """For each quality level the counts of strictly better levels, summed over fragment lengths, without the
    two best levels. Each group has every level: its few levels are gathered in one row and the levels of
    the whole table, a single row, are spread there."""
    own = [c for c in INDEX if c in df.columns and c not in ("flen", "phred")]
    flat = df.where(F.col("motif") == motif).groupBy(*own, "phred").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_meth", "n_unmeth")])
    groups = flat.groupBy(*own).agg(F.collect_list(F.struct("phred", "n_meth", "n_unmeth")).alias("_had"))
    # from the groups themselves, so that both sides read one exchange
    levels = groups.select(F.explode("_had.phred").alias("phred")).agg(F.sort_array(F.collect_set("phred"), asc=False).alias("_levels"))

    def better(c: str, level: Column) -> Column:
        return F.aggregate("_had", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["phred"] > level, x[c]).otherwise(0))

    shown = F.slice("_levels", 3, F.greatest(F.size("_levels") - 2, F.lit(0)))
    full = groups.crossJoin(F.broadcast(levels)).select(*own, "_had", F.explode(shown).alias("phred"))
    return with_beta(full.select(*own, "phred", *[better(c, F.col("phred")).alias(c) for c in ("n_meth", "n_unmeth")])).select(*own, "phred", "n_meth", "n_unmeth", "beta_value")


def value_levels(spark, name: str, values: Sequence) -> DataFrame:
    """A level table of ``densify``."""
    return spark.createDataFrame([(v,) for v in values], [name])

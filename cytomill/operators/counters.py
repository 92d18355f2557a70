"""Several counters of the same reads in one pass.

A counter says which rows it counts, by which keys, and what it sums. Each row of the pileup becomes one narrow row for every
counter that takes it, all are summed by one aggregate, combined before its shuffle, and the counters are told apart when the
sums are written. So the reads are scanned, joined and grouped once, whatever the number of counters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import mbias


@dataclass(frozen=True)
class Counter:
    """``keys`` and ``sums`` by name, the rows ``where`` they count (all if None), and what is made of the sums (``finish``)."""

    keys: Mapping[str, Column]
    sums: Mapping[str, Column]
    where: Column | None = None
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


def calls(position: tuple[str, ...] = ("chrom", "start", "motif")) -> Counter:
    """Methylation calls per position of rows marked by ``filters.marked``; the second of overlapping mates counts once."""
    own = ~F.col("overlap")
    sums = {"n_meth": own & (F.col("status") == C.METH), "n_total": own & F.col("status").isin(C.METH, C.UNMETH)}
    return Counter({c: F.col(c) for c in position}, {k: v.cast("long") for k, v in sums.items()}, F.col("called"), lambda df: df.withColumn("beta_value", C.ratio(F.col("n_meth"), F.col("n_total"))))


def cube(b: mbias.Binning = mbias.Binning(), context: str = "seq_context") -> Counter:
    """The cells of ``mbias.count_cube``."""
    keys, where = mbias.cell(b, context)
    return Counter(keys, {"counts": F.lit(1).cast("long")}, where)


def alike(every: Mapping[str, Counter]) -> list[list[str]]:
    """The names of counters that have the very same columns as keys, together."""
    groups: dict[tuple, list[str]] = {}
    for name, c in every.items():
        groups.setdefault(tuple((k, id(v)) for k, v in c.keys.items()), []).append(name)
    return list(groups.values())


def count_once(reads: DataFrame, counters: Mapping[str, Counter]) -> DataFrame:
    """``counter`` (name), the keys of all counters (``k<i>_<key>``, null in rows of others) and their sums (``v<j>``). Null keys count as a value;
    null sums as 0. Counters with the same key columns are counted in one row and told apart after the aggregate."""
    names, groups = list(counters), alike(counters)
    keys, group_of = [counters[g[0]].keys for g in groups], {n: i for i, g in enumerate(groups) for n in g}
    types = {(i, k): f.dataType for i, own in enumerate(keys) for k, f in zip(own, reads.select(*own.values()).schema.fields, strict=True)}
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def values(g: list[str]) -> list[Column]:
        """Of each counter the rows it takes and its sums."""
        each = [(c.where, v) for c in map(counters.get, g) for v in (one, *[F.coalesce(v.cast("long"), zero) for v in c.sums.values()])]
        return [v if where is None else F.when(where, v).otherwise(zero) for where, v in each]

    summed = [values(g) for g in groups]
    most = max(map(len, summed))

    def entry(i: int) -> Column:
        own = [(keys[j][k] if j == i else F.lit(None)).cast(t).alias(f"g{j}_{k}") for (j, k), t in types.items()]
        held = F.struct(F.lit(i).alias("g"), *own, *[v.alias(f"s{j}") for j, v in enumerate([*summed[i], *[zero] * (most - len(summed[i]))])])
        wheres = [counters[n].where for n in groups[i]]
        return held if any(w is None for w in wheres) else F.when(reduce(or_, [F.coalesce(w, F.lit(False)) for w in wheres]), held)

    if len(groups) == 1:
        rows = reads.select(entry(0).alias("e")).where("e IS NOT NULL").select("e.*")
    else:
        rows = reads.select(F.explode(F.array(*map(entry, range(len(groups))))).alias("e")).where("e IS NOT NULL").select("e.*")
    found = rows.groupBy("g", *[f"g{j}_{k}" for j, k in types]).agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(most)])
    width = max(len(c.sums) for c in counters.values())

    def told(i: int, at: int, name: str) -> Column:
        """The row of one counter, whose own values begin at ``at``."""
        n = len(counters[name].sums)
        own = [(F.col(f"g{i}_{k}") if other == name else F.lit(None)).cast(types[group_of[other], k]).alias(f"k{x}_{k}") for x, other in enumerate(names) for k in counters[other].keys]
        sums = [F.col(f"s{at + 1 + v}") if v < n else zero for v in range(width)]
        return F.when((F.col("g") == i) & (F.col(f"s{at}") > 0), F.struct(F.lit(name).alias("counter"), *own, *[v.alias(f"v{j}") for j, v in enumerate(sums)]))

    each = []
    for i, g in enumerate(groups):
        at = 0
        for name in g:
            each.append(told(i, at, name))
            at += 1 + len(counters[name].sums)
    return found.select(F.explode(F.array(*each)).alias("e")).where("e IS NOT NULL").select("e.*")


def told_apart(counted: DataFrame, counters: Mapping[str, Counter]) -> dict[str, DataFrame]:
    """The table of each counter from what ``count_once`` gave, written and read again: with folders by ``counter`` only its own is read."""
    out = {}
    for i, (name, c) in enumerate(counters.items()):
        own = counted.where(F.col("counter") == name)
        out[name] = c.finish(own.select(*[F.col(f"k{i}_{k}").alias(k) for k in c.keys], *[F.col(f"v{j}").alias(v) for j, v in enumerate(c.sums)]))
    return out

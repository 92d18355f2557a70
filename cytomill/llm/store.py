"""Shared-folder tables, connected components and Arrow batch helpers.

Intermediate results that are read more than once, or that end a long lineage, are written as
Parquet under ``spark.checkpoint.dir``; every executor sees that folder, so a lost executor costs
a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python: bounds a worker's memory whatever the text lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A side is broadcast only after its rows were counted and found to be at most this many narrow rows.
BROADCAST_ROWS = 250_000
#: Keys with more rows than this leave the shuffle of a join and meet their rows by broadcast.
HOT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is missing, a temporary folder is used with a local master
    only (tests), whose executors are the driver; elsewhere it would be another folder on each machine, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cytomill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session stay below BATCH_ROWS and BATCH_BYTES; smaller bounds of the caller's are kept."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(name, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(name, str(most))


def write_table(df: DataFrame, name: str = "t") -> str:
    path = f"{shared_dir(df.sparkSession)}/cytomill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


class Tables:
    """The intermediate tables of one run. ``cut`` writes one and reads it back; ``drop`` removes those that no
    result still reads, with the shuffle files of the jobs that made them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        self.drop(name)
        self.paths[name] = write_table(df, name)
        return self.spark.read.schema(schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            remove(self.spark, path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    return spark.read.schema(schema).parquet(write_table(df, name))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of ended jobs now: it waits for the driver to collect its garbage,
    which an idle driver seldom does, so the files of a run's earlier jobs would stay on disk to its end."""
    spark._jvm.System.gc()


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: these go as soon as the table stands, whatever still refers to
    them. The session's own setting is put back. Lost executors before that are recomputed as ever."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(name: str, *columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for cs in columns for c in cs}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_bound(total: int) -> int:
    """From so many rows on a key is hot. At most total / bound keys are, so they fit in a broadcast whatever the input."""
    return max(HOT_ROWS, -(-total // BROADCAST_ROWS))


def with_value(rows: DataFrame, values: DataFrame, on: list[str], count: str, total: int, whole: bool = True) -> DataFrame:
    """``rows`` joined with the one row that ``values`` has for each key, inner. ``values`` is a written table whose column
    ``count`` has the number of the key's rows, ``total`` of them in all. Few values are broadcast whole, if ``whole``. Of many, those of
    hot keys are broadcast and their rows stay where they are, so no task holds all rows of one; the others meet in a shuffle."""
    if whole and values.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values), on)
    bound = hot_bound(total)
    heavy = values.where(F.col(count) >= bound)
    light = values.where(F.col(count) < bound)
    by_broadcast = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return by_broadcast.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the component being its
    smallest node. Alternating large-star and small-star contraction until nothing changes: every step is a partial
    aggregate and a join whose hot hubs are broadcast, the table stays as large as the edges, and each step is written
    to the shared folder. The number of rounds is logarithmic in the longest path. Nodes without an edge are not returned."""
    spark = edges.sparkSession
    kept = Tables(spark)
    e = kept.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "cc")
    state = None
    while True:
        new = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if new == state or not new[0]:
            break
        state = new
        both = e.union(e.select("b", "a"))
        few = 2 * new[0] <= BROADCAST_ROWS  # then all minima are broadcast, and a step need not be written before the next

        def moved(rows: DataFrame, least: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(least.select("a", "m")), "a") if few else with_value(rows, least, ["a"], "c", 2 * new[0])

        def kept_unless(df: DataFrame, name: str) -> DataFrame:
            return df if few else kept.cut(df, name)

        least = kept_unless(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c")), "cc-least")
        large = moved(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = kept_unless(large, "cc-large")
        least = kept_unless(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "cc-least2")
        e2 = moved(large, least).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        path = write_table(e2, "cc")
        kept.drop_all_but()
        kept.paths["cc"] = path
        e = spark.read.schema("a long, b long").parquet(path)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def bounded_sample(df: DataFrame, h: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` that are first by the hash column ``h``. A threshold from the counted
    rows leaves little more than ``n`` of them before the sort, so tasks send few rows to the driver."""
    total, whole = df.count(), 1 << 30
    if total > n:
        df = df.where(F.pmod(F.col(h), F.lit(whole)) < int(whole * min(1.0, 1.25 * n / total)) + 1)
    return df.orderBy(F.pmod(F.col(h), F.lit(whole)), h).limit(n)

"""Text sinks: BED, stratified BED and Bismark lines, one compressed file per motif and contig."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import files

#: The columns of the formats.
BED6 = ("chrom", "start", "end", "motif", "score", "strand")
BED9 = (*BED6, "beta_value", "n_meth", "n_total")
BED27 = (*BED9, *[f"{s}_{c}" for s in C.STRATA for c in ("beta_value", "n_meth", "n_total")])
FORMATS = ("bed", "bismark", "stratified_bed")
#: Names of single files: both fields are needed, as each motif and contig has a file of its own.
TEMPLATE = "[motif]_[chrom].txt.gz"


def header(columns: Iterable[str]) -> str:
    return "#" + "\t".join(columns)


def _lines(called: DataFrame, columns: Iterable[str]) -> DataFrame:
    made = [C.fixed8(F.col(c)) if c.endswith("beta_value") else F.lit(".") if c == "score" else F.col(c).cast("string") for c in columns]
    return called.select("motif", "chrom", "start", F.concat_ws("\t", *made).alias("line"))


def bed_lines(called: DataFrame) -> DataFrame:
    return _lines(called, BED9)


def stratified_lines(called: DataFrame) -> DataFrame:
    return _lines(called, BED27)


def index_lines(index: DataFrame) -> DataFrame:
    return _lines(index, index.columns)


def bismark_lines(reads: DataFrame) -> DataFrame:
    """One line per read and position; strand column: + for methylated. Overlapping mates and other statuses are left out."""
    r = reads.where(~F.col("overlap") & F.col("status").isin(C.METH, C.UNMETH))
    sign = F.when(F.col("status") == C.METH, "+").otherwise("-")
    keep = [c for c in ("file_ord",) if c in r.columns]
    line = F.concat_ws("\t", F.col("read_name").cast("string"), sign, "chrom", F.col("start").cast("string"), C.call_symbol(F.col("motif"), F.col("status")))
    return r.select("motif", "chrom", "start", *keep, line.alias("line"))


def write(lines: DataFrame, out: str, columns: Iterable[str] | None = None, single_file: bool = False, template: str = TEMPLATE) -> None:
    """Sorted gzip text under ``out``/motif=…/chrom=…, a file per task and group; a large contig's rows are
    range-partitioned over tasks in file name order. With ``single_file`` the parts of a group are
    joined by tasks, on whatever store, behind a header line to the file under ``out`` that ``template`` names by ``[motif]`` and ``[chrom]``."""
    if not all(f in template for f in ("[motif]", "[chrom]")):
        raise ValueError(f"{template} needs the fields [motif] and [chrom]")
    order = ["motif", "chrom", "start", *[c for c in ("file_ord",) if c in lines.columns]]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("motif", "chrom", "line")
    dealt.write.mode("overwrite").partitionBy("motif", "chrom").option("compression", "gzip").text(out)
    if single_file:
        _join_groups(lines.sparkSession, out, columns, template)


def _join_groups(spark: SparkSession, out: str, columns: Iterable[str] | None, template: str) -> None:
    """The parts of each group as one file: gzip members behind each other, copied by a task per group from store to store. The file gets its
    name when it is whole, so a task that is tried again leaves nothing half written."""
    groups: dict[tuple[str, str], list[str]] = {}
    for path in files.listed(out):
        folders = path.split("/")
        if len(folders) == 3 and folders[2].startswith("part-") and folders[0].startswith("motif="):
            groups.setdefault(tuple(unquote(f.split("=", 1)[1]) for f in folders[:2]), []).append(f"{out}/{path}")
    if groups:
        rows = [(f"{out}/{template.replace('[motif]', m).replace('[chrom]', c)}", sorted(parts)) for (m, c), parts in groups.items()]
        head = gzip.compress((header(columns) + "\n").encode(), mtime=0) if columns else b""

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    files.write_joined(name, head, parts)
                yield batch.select([0])

        spark.createDataFrame(rows, "name string, parts array<string>").repartition(len(rows)).mapInArrow(join, "name string").write.format("noop").mode("overwrite").save()
    for folder in {p.removeprefix(f"{out}/").split("/")[0] for parts in groups.values() for p in parts}:
        files.remove(f"{out}/{folder}")


def check_formats(formats: Iterable[str]) -> tuple[str, ...]:
    found = tuple(formats)
    if unknown := set(found) - set(FORMATS):
        raise AssertionError(f"unknown output formats {sorted(unknown)}")
    return found

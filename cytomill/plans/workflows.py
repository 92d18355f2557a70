"""Workflows from files to files: index, calls, bias statistics, plots, coverage."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggspec, calls, counters, filters, index, mbias, pileup, plateau, sites
from ..sources import bed, fasta, files, sam, writers

POSITION = ("chrom", "start", "motif")


def make_index(spark: SparkSession, genome: str, out: str, motifs: Sequence[str] = ("CG",), annotations: Sequence[str] = (), context_size: int = 2, single_file: bool = False) -> DataFrame:
    """Motif positions of a FASTA file, written as BED lines by motif and contig."""
    g = fasta.read(spark, genome, flank=max(fasta.FLANK, context_size + 2))
    df = index.motif_index(g, motifs, annotations, context_size)
    writers.write(writers.index_lines(df), out, df.columns, single_file)
    return df


#: Contigs of an index that are named to the reader of alignments at most.
NAMED_CONTIGS = 1000


def reads_of(spark: SparkSession, alignments: str, idx: DataFrame) -> DataFrame:
    """The alignments on the contigs of an index: where these are few, an indexed BAM file is opened at their chunks only."""
    found = [r[0] for r in idx.select("chrom").distinct().limit(NAMED_CONTIGS + 1).collect()]
    return sam.read(spark, alignments, found if len(found) <= NAMED_CONTIGS else None)


def resolve_sites(spark: SparkSession, trimming: tuple[str, object] | None, max_read_length: int) -> tuple[DataFrame | None, int]:
    """Dense cutting sites and their largest fragment length from a trimming choice (``config.trimming``)."""
    if trimming is None:
        return None, 0
    kind, value = trimming
    found = sites.from_fragment_ends(spark, value, max_read_length) if kind == "frag_end" else sites.check(spark.read.parquet(value).select(*sites.COLUMNS))
    full = sites.dense(found)
    return full, int(full.agg(F.max("flen")).first()[0])


def call(spark: SparkSession, alignments: str, index_path: str, out: str, formats: Sequence[str] = ("bed",), trimming: tuple[str, object] | None = None, max_read_length: int = 101, min_mapq: int = 25, min_phred: int = 25, single_file: bool = False, templates: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Methylation calls; the filtered reads are computed once for all output formats. With ``single_file``, a format's
    ``templates`` entry names its files under ``out`` by ``[motif]`` and ``[chrom]``. The frames returned read what was written or
    can be computed again from the files."""
    templates = dict(templates or {})
    formats = writers.check_formats(formats)
    idx = bed.read_index(spark, index_path).drop("watson_base")
    s, top = resolve_sites(spark, trimming, max_read_length)
    reads = filters.filtered(pileup.pileup_reads(reads_of(spark, alignments, idx), idx), s, top, min_mapq, min_phred)
    if len(formats) > 1:
        reads = reads.persist(StorageLevel.MEMORY_AND_DISK)
    done: dict[str, DataFrame] = {}
    if "bed" in formats:
        done["bed"] = calls.with_all_positions(idx, calls.call(reads))
        writers.write(writers.bed_lines(done["bed"]), f"{out}/bed", writers.BED9, single_file, templates.get("bed", writers.TEMPLATE))
    if "stratified_bed" in formats:
        done["stratified_bed"] = calls.with_all_positions(idx, calls.stratified_call(reads))
        writers.write(writers.stratified_lines(done["stratified_bed"]), f"{out}/stratified_bed", writers.BED27, single_file, templates.get("stratified_bed", writers.TEMPLATE))
    if "bismark" in formats:
        done["bismark"] = writers.bismark_lines(reads)
        writers.write(done["bismark"], f"{out}/bismark", None, single_file, templates.get("bismark", writers.TEMPLATE))
    reads.unpersist()
    return done


def run_pileup(spark: SparkSession, alignments: str, index_path: str, steps: Sequence[Callable[[DataFrame], DataFrame]], counters: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The place for a user's own operators: ``steps`` take and return rows of ``pileup.pileup_reads`` one after the other
    (filters, marks, further columns), ``counters`` make a table each from the last step's rows, any table at all. Each that is read
    scans the reads; a counter that is never read costs nothing. Counters that sum by keys can share one scan: ``count_reads``."""
    idx = bed.read_index(spark, index_path).drop("watson_base")
    reads = pileup.pileup_reads(reads_of(spark, alignments, idx), idx)
    for step in steps:
        reads = reads.transform(step)
    return {name: reads.transform(f) for name, f in counters.items()}


def count_reads(spark: SparkSession, alignments: str, index_path: str, out: str, own: Mapping[str, counters.Counter] | None = None, trimming: tuple[str, object] | None = None, max_read_length: int = 101, min_mapq: int = 25, min_phred: int = 25, binning: mbias.Binning = mbias.Binning()) -> dict[str, DataFrame]:
    """Calls, the count cube (where the index has sequence contexts) and a user's ``own`` counters from one scan of the reads, one join and one
    aggregate, written to ``out`` in a folder for each. Own counters see all rows of the pileup with ``called`` and ``overlap`` (``filters.marked``)."""
    idx = bed.read_index(spark, index_path).drop("watson_base")
    s, top = resolve_sites(spark, trimming, max_read_length)
    reads = filters.marked(pileup.pileup_reads(reads_of(spark, alignments, idx), idx, most=None), s, top, min_mapq, min_phred)
    every = {"calls": counters.calls(), **({"stats": counters.cube(binning)} if "seq_context" in idx.columns else {}), **(own or {})}
    counted = counters.count_once(reads, every)
    counted.write.mode("overwrite").partitionBy("counter").parquet(out)
    return counters.told_apart(spark.read.schema(counted.schema).parquet(out), every)


def collect_stats(spark: SparkSession, alignments: str, index_path: str, out: str, binning: mbias.Binning = mbias.Binning(), tsv: bool = False) -> DataFrame:
    """The count cube of reads at index positions with a sequence context, as Parquet, and with ``tsv`` as tab-separated
    text with a header in ``out``_tsv too."""
    idx = bed.read_index(spark, index_path).drop("watson_base")
    cube = mbias.count_cube(pileup.pileup_reads(reads_of(spark, alignments, idx), idx, mates=False), binning)
    cube.write.mode("overwrite").parquet(out)
    if tsv:
        spark.read.parquet(out).write.mode("overwrite").csv(f"{out}_tsv", sep="\t", header=True, compression="gzip")
    return spark.read.parquet(out)


def collect_many(spark: SparkSession, alignments: Sequence[str], index_path: str, out: str, binning: mbias.Binning = mbias.Binning()) -> DataFrame:
    """The count cube of many inputs, as ``collect_stats`` has it for one. Each input's own cube is kept under ``out``/parts by the input's and the
    index's fingerprints as soon as it is counted, so a run that ended early, or that has new inputs, reads only what is not there yet.
    The parts of these inputs, and no others, are summed to ``out``/counts; an input that is listed twice counts twice."""
    idx = bed.read_index(spark, index_path).drop("watson_base")
    mark = f"{files.fingerprint(index_path)}-{hashlib.sha256(repr(binning).encode()).hexdigest()[:8]}"
    parts = {a: f"{out}/parts/{files.fingerprint(a)}-{mark}" for a in dict.fromkeys(alignments)}
    for source, path in parts.items():
        if not files.exists(f"{path}/_SUCCESS"):
            mbias.count_cube(pileup.pileup_reads(reads_of(spark, source, idx), idx, mates=False), binning).write.mode("overwrite").parquet(path)
    cubes = [spark.read.parquet(parts[a]) for a in alignments]
    summed = reduce(DataFrame.unionByName, cubes).groupBy(*mbias.CUBE, "meth_status").agg(F.sum("counts").alias("counts"))
    summed.write.mode("overwrite").parquet(f"{out}/counts")
    return spark.read.parquet(f"{out}/counts")


def evaluate_mbias(spark: SparkSession, counts: str, out: str, context_size: int = 5, cfg: plateau.PlateauConfig | None = None, reuse: bool = False, normal: Mapping[str, float] | None = None, text: bool = False) -> dict[str, DataFrame]:
    """All bias tables: statistics, classic roll-up, cutting sites, masked statistics, quality thresholds (both).

    With ``normal`` (the ``trimming`` settings of a configuration: ``min_plateau_perc``, ``max_std_within_plateau``, ``min_flen_considered_for_trimming``)
    the cutting sites come from each stratum's longest even stretch instead of a fitted plateau. With ``text`` the tables that people read are
    written as tab-separated text too, in order."""

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    if reuse and files.modified(f"{out}/stats/_SUCCESS") is not None:
        stats = spark.read.parquet(f"{out}/stats")
    else:
        stats = stored("stats", mbias.used_phred(mbias.stats(spark.read.parquet(counts), context_size)))
    classic = stored("classic", mbias.classic(stats))
    if normal is None:
        fitted = plateau.detect(classic, cfg or plateau.PlateauConfig())
    else:
        least = int(normal["min_flen_considered_for_trimming"])
        cg = classic.where("motif = 'CG'")
        even = plateau.normal_plateaus(cg.where(F.col("flen") >= least), min_share=normal["min_plateau_perc"], max_std=normal["max_std_within_plateau"], min_flen=1)
        short = cg.where(F.col("flen") < least).select("bs_strand", F.col("flen").cast("long").alias("flen"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).distinct()
        fitted = even.union(short)
    found = stored("cutting_sites", fitted)
    kept = stored("masked", mbias.masked(stats, sites.dense(found)))
    done = {
        "stats": stats, "classic": classic, "cutting_sites": found, "masked": kept,
        "phred_thresholds": stored("phred_thresholds", mbias.phred_thresholds(stats)), "masked_phred_thresholds": stored("masked_phred_thresholds", mbias.phred_thresholds(kept)),
    }
    if text:
        for name in ("classic", "phred_thresholds", "masked_phred_thresholds"):
            mbias.ordered(done[name]).write.mode("overwrite").csv(f"{out}/{name}_tsv", sep="\t", header=True, compression="gzip")
    return done


def mbias_plots(spark: SparkSession, spec: Mapping[str, dict], datasets: Mapping[str, str], out: str) -> list[str]:
    """Charts of a specification as Vega-Lite files, and a report that links them; ``out`` and the datasets are paths or URIs. Aggregates
    are kept as Parquet under their digest and the fingerprint of their dataset, so they are used again as long as that holds the same,
    and the missing ones of a dataset come from one scan of it."""
    configs = aggspec.plot_configs(spec, datasets)
    tasks = list(dict.fromkeys(t for c in configs for t in c.tasks()))
    done = {}
    for name, source in datasets.items():
        mark = files.fingerprint(source)
        path = {t: f"{out}/aggregates/{t.digest()}-{mark}" for t in tasks if t.dataset == name}
        missing = [t for t in path if not files.exists(f"{path[t]}/_SUCCESS")]
        if missing:
            table = spark.read.parquet(source)
            held = f"{out}/aggregates/rolled-{uuid.uuid4().hex}"
            aggspec.rolled(table, missing).write.partitionBy("task").parquet(held)
            every = spark.read.schema(aggspec.rolled(table, missing).schema).parquet(held)
            for t in missing:
                aggspec.of_task(every, missing, t, table.columns).write.mode("overwrite").parquet(path[t])
            files.remove(held)
        done |= {t: spark.read.parquet(p) for t, p in path.items()}
    groups: dict[str, list[str]] = {}
    for n, c in enumerate(configs):
        name = f"{c.group}_{n}.json"
        files.write_text(f"{out}/{name}", json.dumps(aggspec.chart(c, aggspec.plot_data(c, done)), default=str))
        groups.setdefault(c.group, []).append(name)
    files.write_text(f"{out}/report.html", aggspec.report(groups))
    return [p for ps in groups.values() for p in ps]


def evaluate_calls(spark: SparkSession, called: str | DataFrame, out: str, max_coverage: int = 80, chart: str | None = None) -> DataFrame:
    """The coverage histogram as Parquet, and with ``chart`` a line chart of it, a panel for each motif."""
    df = bed.read(spark, called) if isinstance(called, str) else called
    hist = calls.coverage_histogram(df, max_coverage)
    hist.write.mode("overwrite").parquet(out)
    hist = spark.read.parquet(out)
    if chart:
        Path(chart).write_text(json.dumps(aggspec.line_chart(hist, {"x": "coverage", "y": "counts", "column": "motif"}, "Coverage")))
    return hist


def plot_sites(found: DataFrame, chart: str) -> None:
    """A line chart of cutting sites by fragment length, a panel for each strand, and for each motif if there is one."""
    row = {"row": "motif"} if "motif" in found.columns else {}
    Path(chart).write_text(json.dumps(aggspec.line_chart(sites.plot_table(found), {"x": "flen", "y": "cut_pos", "color": "cut_end", "column": "bs_strand", **row}, "Cutting sites")))


def merge_calls(spark: SparkSession, called: str, out: str, by_lines: bool = False, single_file: bool = False) -> DataFrame:
    """Merge the strands of a call file, by positions or, as some tools do, by consecutive lines."""
    df = bed.read(spark, called)
    merged = calls.merge_lines(df, ("chrom", "start")) if by_lines else calls.merge_strands(df)
    columns = [c for c in df.columns if c in merged.columns]
    made = [C.fixed8(F.col(c)) if c.endswith("beta_value") else F.col(c).cast("string") for c in columns]
    lines = merged.select("motif", "chrom", "start", F.concat_ws("\t", *made).alias("line"))
    writers.write(lines, out, columns, single_file)
    return merged

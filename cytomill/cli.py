"""Command line: make-index, call, stats, evaluate-mbias, mbias-plots, evaluate-calls, merge-calls."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from . import config
from .operators import mbias, plateau
from .plans import workflows
from .sources import writers


def session(app: str) -> SparkSession:
    return SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cytomill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(f"--{x}", required=True)
        return c

    c = command("make-index", "genome", "out")
    for m in ("cg", "chg", "chh", "cwg"):
        c.add_argument(f"--{m}", action="store_true")
    c.add_argument("--triplet-seq", action="store_true")
    c.add_argument("--seq-context", type=int, default=0)
    c.add_argument("--single-file", action="store_true")
    c = command("call", "alignments", "index", "out")
    c.add_argument("--formats", default="bed")
    c.add_argument("--trimming")
    c.add_argument("--max-read-length", type=int, default=101)
    c.add_argument("--config")
    c.add_argument("--single-file", action="store_true")
    c.add_argument("--template", default=writers.TEMPLATE, help="names of single files by [motif] and [chrom]")
    c = command("stats", "alignments", "index", "out")
    c.add_argument("--config")
    c.add_argument("--tsv", action="store_true")
    c = command("evaluate-mbias", "counts", "out")
    c.add_argument("--plateau-detection", default='{"algorithm": "binomial"}')
    c.add_argument("--use-cached", action="store_true")
    c.add_argument("--text", action="store_true", help="tables that people read as tab-separated text too")
    c.add_argument("--config")
    c = command("mbias-plots", "spec", "datasets", "out")
    c = command("evaluate-calls", "calls", "out")
    c.add_argument("--config")
    c.add_argument("--chart")
    c = command("merge-calls", "calls", "out")
    c.add_argument("--by-lines", action="store_true")
    c.add_argument("--single-file", action="store_true")
    return p


def plateau_config(text: str) -> plateau.PlateauConfig | None:
    """The settings of a fitted plateau (``binomial``), or None for even stretches by the ``trimming`` settings (``normal``)."""
    found = json.loads(text)
    algorithm = found.pop("algorithm", None)
    if algorithm not in ("binomial", "normal"):
        raise ValueError("plateau detection needs an algorithm, binomial or normal")
    if algorithm == "normal":
        if found:
            raise ValueError("even stretches are set in the configuration's trimming section")
        return None
    return plateau.PlateauConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    cfg = config.assemble({"name": "sample", "output_dir": getattr(a, "out", ".")}, None, getattr(a, "config", None))
    spark = session(f"cytomill {a.command}")
    if a.command == "make-index":
        motifs = [m.upper() for m in ("cg", "chg", "chh", "cwg") if getattr(a, m)]
        notes = ["triplet_seq"] * a.triplet_seq + ["seq_context"] * bool(a.seq_context)
        workflows.make_index(spark, a.genome, a.out, motifs, notes, a.seq_context or 2, a.single_file)
    elif a.command == "call":
        q = cfg["basic_quality_filtering"]
        trim = config.trimming(a.trimming, cfg) if a.trimming else None
        workflows.call(spark, a.alignments, a.index, a.out, a.formats.split(","), trim, a.max_read_length, q["min_mapq"], q["min_phred_score"], a.single_file, {f: a.template for f in writers.FORMATS})
    elif a.command == "stats":
        s = cfg["stats"]
        workflows.collect_stats(spark, a.alignments, a.index, a.out, mbias.Binning(s["seq_context_size"], s["max_flen_with_single_flen_resolution"], s["flen_bin_size"], s["max_flen"], s["phred_bin_size"], s["max_phred"]), a.tsv)
    elif a.command == "evaluate-mbias":
        fitted = plateau_config(a.plateau_detection)
        workflows.evaluate_mbias(spark, a.counts, a.out, cfg["stats"]["seq_context_size"], fitted, a.use_cached, cfg["trimming"] if fitted is None else None, a.text)
    elif a.command == "mbias-plots":
        if not a.spec.endswith(".json"):
            raise SystemExit("a plot specification is a JSON file; Python modules are not executed")
        Path(a.out).mkdir(parents=True, exist_ok=True)
        workflows.mbias_plots(spark, json.loads(Path(a.spec).read_text()), config.named_paths(a.datasets), a.out)
    elif a.command == "evaluate-calls":
        workflows.evaluate_calls(spark, a.calls, a.out, cfg["coverage_analysis"]["max_per_motif_cov"], a.chart)
    else:
        workflows.merge_calls(spark, a.calls, a.out, a.by_lines, a.single_file)


if __name__ == "__main__":
    main()

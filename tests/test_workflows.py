"""Whole workflows on small files, the registered queries, streaming."""

import gzip
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cytomill.functions import columns as C
from cytomill.operators import calls, counters, filters, mbias, pileup, plateau
from cytomill.plans import queries, workflows
from cytomill.sources import bed, sam, writers
from cytomill.streaming import running

DATA = "/root/testdata/sf0.001"
GENOME = "TTACGTTCGAACGTACGTTTACGATTCGTACGTTAGCATCGA" * 3


@pytest.fixture()
def files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(f">c1\n{GENOME}\n")
    rows = []
    for i in range(40):
        pos, (f1, f2) = i * 2, ((99, 147) if i % 2 else (163, 83))
        seq = GENOME[pos : pos + 40]
        first, second = (seq.replace("C", "T") if i % 3 else seq), (seq if i % 3 == 0 else seq.replace("C", "T"))
        rows += ["\t".join(map(str, (f"r{i}", f, "c1", pos + 1, 60, f"{len(s)}M", "=", pos + 1, t, s, "I" * len(s)))) for f, s, t in ((f1, first, 60), (f2, second, -60))]
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n" + "\n".join(rows) + "\n")
    workflows.make_index(spark, str(tmp_path / "g.fa"), str(tmp_path / "index"), ("CG",), ("seq_context",), 2, single_file=True)
    return tmp_path, str(tmp_path / "index" / "CG_c1.txt.gz")


def test_calls_from_files(spark, files):
    tmp, index = files
    done = workflows.call(spark, str(tmp / "a.sam"), index, str(tmp / "calls"), ("bed", "bismark", "stratified_bed"), ("frag_end", {s: (0, 0) for s in ("c_bc", "c_bc_rv", "w_bc", "w_bc_rv")}), 60, single_file=True)
    lines = gzip.open(tmp / "calls" / "bed" / "CG_c1.txt.gz", "rt").read().splitlines()
    assert lines[0].startswith("#chrom\tstart") and len(lines) == 1 + done["bed"].count() == GENOME.count("CG") * 2 + 1
    assert sum(int(x.split("\t")[-1]) for x in lines[1:]) > 100 and any(x.split("\t")[-1] == "0" and "nan" in x for x in lines[1:])
    assert done["bismark"].count() == sum(int(x.split("\t")[-1]) for x in lines[1:])
    wide = gzip.open(tmp / "calls" / "stratified_bed" / "CG_c1.txt.gz", "rt").read().splitlines()
    assert [x.split("\t")[:9] for x in wide] == [x.split("\t") for x in lines] and len(wide[0].split("\t")) == 27
    merged = workflows.merge_calls(spark, str(tmp / "calls" / "bed" / "CG_c1.txt.gz"), str(tmp / "merged"), single_file=True)
    assert merged.count() == GENOME.count("CG") and workflows.evaluate_calls(spark, str(tmp / "calls" / "bed" / "CG_c1.txt.gz"), str(tmp / "cov"), 10).count() == 33


def test_templates_text_and_own_operators(spark, files):
    tmp, index = files
    workflows.call(spark, str(tmp / "a.sam"), index, str(tmp / "named"), ("bed",), None, single_file=True, templates={"bed": "x/s1_[motif]_chr-[chrom].bed.gz"})
    assert (tmp / "named" / "bed" / "x" / "s1_CG_chr-c1.bed.gz").exists() and not list((tmp / "named" / "bed").glob("motif=*"))
    with pytest.raises(ValueError):
        workflows.call(spark, str(tmp / "a.sam"), index, str(tmp / "named"), ("bed",), None, single_file=True, templates={"bed": "x.gz"})
    counts = workflows.collect_stats(spark, f"file://{tmp}/a.sam", index, str(tmp / "counts"), tsv=True)
    again = spark.read.csv(str(tmp / "counts_tsv"), sep="\t", header=True)
    assert again.count() == counts.count() > 0 and again.columns == counts.columns
    got = workflows.run_pileup(spark, str(tmp / "a.sam"), index, [lambda r: r.where("phred >= 20"), lambda r: r.withColumn("half", F.col("start") % 2)], {"by_half": lambda r: r.groupBy("half").count(), "never": lambda r: r.where("no_such_column") if False else r})
    assert sum(r["count"] for r in got["by_half"].collect()) == got["never"].count() > 0
    hist = workflows.evaluate_calls(spark, str(tmp / "named" / "bed" / "x" / "s1_CG_chr-c1.bed.gz"), str(tmp / "cov"), chart=str(tmp / "cov.json"))
    assert hist.count() == 3 * 81 and json.loads((tmp / "cov.json").read_text())["encoding"]["column"]["field"] == "motif"
    workflows.plot_sites(spark.createDataFrame([("w_bc", 50, 0, 40)], "bs_strand string, flen long, start long, end long"), str(tmp / "sites.json"))
    assert len(json.loads((tmp / "sites.json").read_text())["data"]["values"]) == 2


def test_lines_are_merged_across_stretches(spark, monkeypatch):
    from cytomill.operators import calls

    monkeypatch.setattr(calls, "STRETCH", 7)
    rows = [("CG" if i % 3 else "CHH", f"c{i // 40}", i * 3 % 101 + i, i * 3 % 101 + i + 1, "+", i, i + 5) for i in range(97)]
    df = spark.createDataFrame(rows, "motif string, chrom string, start int, end int, strand string, n_meth long, n_total long").repartition(3)
    got = {tuple(r)[:6] for r in calls.merge_lines(df, ("chrom", "start")).select("motif", "chrom", "start", "end", "n_meth", "n_total").collect()}
    want = set()
    for m in ("CG", "CHH"):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[1:3])
        want |= {(m, a[1], a[2], b[3], a[5] + b[5], a[6] + b[6]) for a, b in zip(own[::2], own[1::2], strict=False)}
    assert got == want


def test_bias_from_files(spark, files):
    tmp, index = files
    workflows.collect_stats(spark, str(tmp / "a.sam"), index, str(tmp / "counts"), mbias.Binning(5, 150, 10, 500, 5, 40))
    cfg = plateau.PlateauConfig(plateau_flen=10, steps=20, always_accept=0.5, min_plateau_length=5)
    done = workflows.evaluate_mbias(spark, str(tmp / "counts"), str(tmp / "bias"), 5, cfg)
    assert done["stats"].count() > 0 and done["masked"].count() == done["stats"].count() and set(done) == {"stats", "classic", "cutting_sites", "masked", "phred_thresholds", "masked_phred_thresholds"}
    spec = {"g": {"datasets": ["full"], "plot_params": {}, "aes_mappings": [{"x": "pos", "y": "beta_value", "color": "bs_strand"}]}}
    names = workflows.mbias_plots(spark, spec, {"full": str(tmp / "bias" / "stats")}, str(tmp))
    assert json.loads((tmp / names[0]).read_text())["data"]["values"] and names[0] in (tmp / "report.html").read_text()


def test_aggregates_are_kept_by_content(spark, tmp_path):
    """On URIs; a dataset that is touched is not read again, one that is written anew is."""
    uri = f"file://{tmp_path}"
    rows = [("CG", "w_bc", f, p, f + p, 3, 0.5) for f in (50, 60) for p in range(1, 9)]
    df = spark.createDataFrame(rows, "motif string, bs_strand string, flen long, pos long, n_meth long, n_unmeth long, beta_value double")
    df.coalesce(1).write.parquet(f"{uri}/stats")
    spec = {"g": {"datasets": ["full"], "plot_params": {}, "aes_mappings": [{"x": "pos", "y": "beta_value"}, {"x": "flen", "y": "beta_value"}, {"x": "pos", "y": "n_meth", "color": "flen"}]}}
    names = workflows.mbias_plots(spark, spec, {"full": f"{uri}/stats"}, f"{uri}/out/deep")
    assert len(names) == 3 and all((tmp_path / "out" / "deep" / n).exists() for n in names) and (tmp_path / "out" / "deep" / "report.html").exists()
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "deep" / "aggregates").iterdir()}
    assert len(kept) == 3  # nothing else is left
    for p in (tmp_path / "stats").glob("part-*"):
        os.utime(p, (1, 1))
    workflows.mbias_plots(spark, spec, {"full": f"{uri}/stats"}, f"{uri}/out/deep")
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out" / "deep" / "aggregates").iterdir()} == kept
    df.withColumn("n_meth", F.col("n_meth") + 1).coalesce(1).write.mode("overwrite").parquet(f"{uri}/stats")
    workflows.mbias_plots(spark, spec, {"full": f"{uri}/stats"}, f"{uri}/out/deep")
    assert len(list((tmp_path / "out" / "deep" / "aggregates").iterdir())) == 6
    data = json.loads((tmp_path / "out" / "deep" / names[2]).read_text())["data"]["values"]
    assert {(r["flen"], r["pos"], r["n_meth"]) for r in data} == {(f, p, f + p + 1) for _, _, f, p, *_ in rows}


def test_counters_share_one_scan(spark, files, tmp_path):
    """Calls, statistics and an own counter equal those computed alone; the plan has the reads once."""
    tmp, index = files
    own = counters.Counter({"half": F.col("start") % 2, "motif": F.col("motif")}, {"seen": F.lit(1), "good": F.col("called").cast("long")}, F.col("phred") >= 20)
    binning = mbias.Binning(5, 150, 10, 500, 5, 40)
    trimming = ("frag_end", {s: (1, 2) for s in C.STRANDS})
    got = workflows.count_reads(spark, str(tmp / "a.sam"), index, str(tmp_path / "counted"), {"own": own}, trimming, 101, 10, 15, binning)
    idx = bed.read_index(spark, index).drop("watson_base")
    reads = pileup.pileup_reads(sam.read(spark, str(tmp / "a.sam")), idx)
    s, top = workflows.resolve_sites(spark, trimming, 101)
    assert sorted(map(repr, got["calls"].collect())) == sorted(map(repr, calls.call(filters.filtered(reads, s, top, 10, 15)).collect()))
    assert got["calls"].count() > 10 and got["stats"].columns == mbias.count_cube(reads, binning).columns
    assert sorted(map(repr, got["stats"].collect())) == sorted(map(repr, mbias.count_cube(reads, binning).collect()))
    assert sum(r["seen"] for r in got["own"].collect()) == reads.where("phred >= 20").count()
    once = counters.count_once(filters.marked(reads, s, top, 10, 15), {"calls": counters.calls(), "stats": counters.cube(binning), "own": own})
    once.collect()
    plan = once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1 and plan.count("Window") >= 1


def test_counts_of_many_inputs_go_on_where_they_ended(spark, files, tmp_path):
    tmp, index = files
    inputs = [f"file://{tmp}/{n}.sam" for n in "abc"]
    whole = (tmp / "a.sam").read_text().splitlines(keepends=True)
    (tmp / "b.sam").write_text("".join(whole[:30]))
    binning = mbias.Binning(5, 150, 10, 500, 5, 40)
    with pytest.raises(FileNotFoundError):  # the third is not there yet
        workflows.collect_many(spark, inputs, index, f"file://{tmp_path}/many", binning)
    (tmp / "c.sam").write_text("".join([whole[0], *whole[40:]]))
    with pytest.raises(Exception):  # noqa: B017
        workflows.collect_many(spark, [*inputs[:2], f"file://{tmp}/none.bam"], index, f"file://{tmp_path}/many", binning)
    first = workflows.collect_many(spark, inputs[:2], index, f"file://{tmp_path}/many", binning)
    kept = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "many" / "parts").glob("*/_SUCCESS")}
    assert len(kept) == 2
    got = workflows.collect_many(spark, inputs, index, f"file://{tmp_path}/many", binning)
    now = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "many" / "parts").glob("*/_SUCCESS")}
    assert len(now) == 3 and kept.items() <= now.items()
    want: dict = {}
    for name in "abc":
        for r in workflows.collect_stats(spark, str(tmp / f"{name}.sam"), index, str(tmp_path / name), binning).collect():
            want[r[:-1]] = want.get(r[:-1], 0) + r[-1]
    assert {r[:-1]: r[-1] for r in got.collect()} == want and first.columns == got.columns


def test_single_files_on_a_store(spark, tmp_path):
    """Several parts of a group become one file behind one header, by URI; names with odd letters come back."""
    rows = [("CG", c, i, f"{c}\t{i}") for c in ("c1", "HLA*01:02", "c 2") for i in range(50)]
    lines = spark.createDataFrame(rows, "motif string, chrom string, start long, line string").repartition(5)
    writers.write(lines, f"file://{tmp_path}/out", ("chrom", "start"), True, "x/[motif]_[chrom].bed.gz")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["x"]
    for c in ("c1", "HLA*01:02", "c 2"):
        text = gzip.open(tmp_path / "out" / "x" / f"CG_{c}.bed.gz", "rt").read().splitlines()
        assert text == ["#chrom\tstart", *(f"{c}\t{i}" for i in range(50))]
    assert not list((tmp_path / "out").rglob("*.passing"))


def test_normal_plateaus_and_text_tables(spark, tmp_path):
    rows = [("CG" if k else "CHH", "WCGWW"[:5], "w_bc", f, 30, p, m, 40 if (p < 5) == (m == "n_unmeth") else 60) for k in (0, 1) for f in (40, 80) for p in range(1, 60) for m in ("n_meth", "n_unmeth")]
    cube = spark.createDataFrame([("WWCGW" if r[0] == "CG" else "WWCWW", *r[2:]) for r in rows], "seq_context string, bs_strand string, flen long, phred long, pos long, meth_status string, counts long")
    cube.write.parquet(str(tmp_path / "counts"))
    settings = {"min_plateau_perc": 0.5, "max_std_within_plateau": 0.2, "min_flen_considered_for_trimming": 50}
    done = workflows.evaluate_mbias(spark, str(tmp_path / "counts"), str(tmp_path / "bias"), normal=settings, text=True)
    found = {(r["bs_strand"], r["flen"]): (r["start"], r["end"]) for r in done["cutting_sites"].collect()}
    assert found["w_bc", 40] == (0, 0) and found["w_bc", 80][1] - found["w_bc", 80][0] >= 29
    text = spark.read.csv(str(tmp_path / "bias" / "classic_tsv"), sep="\t", header=True)
    assert text.count() == done["classic"].count() and [(r["motif"], int(r["flen"]), int(r["pos"])) for r in text.collect()] == sorted((r["motif"], r["flen"], r["pos"]) for r in done["classic"].collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "part"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({queries.ORACLES[name]})").fetchall()

    def norm(rows):
        return sorted([tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows])

    assert norm(map(tuple, df.select(*cols).collect())) == norm(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_optional_folders():
    code = "import sys; sys.modules['cytomill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e._methylation.QUERIES); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("1", 5, 8, 30), ("1", 5, 4, 3)], "chrom string, start int, status int, mapq int").write.parquet(str(tmp_path / "r"))
    from cytomill.operators import filters

    df = filters.mapq_filter(spark.read.parquet(str(tmp_path / "r")), 10).groupBy("chrom", "start").agg(F.count("*"))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(mapq,10)" in plan and "status" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_running_calls(spark, tmp_path):
    rows = [("1", i % 3, "CG", 8 if i % 2 else 4) for i in range(30)]
    spark.createDataFrame(rows, "chrom string, start int, motif string, status int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom string, start int, motif string, status int").parquet(str(tmp_path / "in"))
    q = running.running_calls(stream).writeStream.outputMode("complete").format("memory").queryName("calls_so_far").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select start, n_meth, n_total from calls_so_far").collect()} == {(0, 5, 10), (1, 5, 10), (2, 5, 10)}


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 3) as ts, id % 2 as k from range(40)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "in"))
    for name, df in (("tumbling", running.windowed_counts(stream, "ts", ("k",), "30 minutes")), ("sliding", running.windowed_counts(stream, "ts", ("k",), "30 minutes", "15 minutes")), ("sessions", running.sessions(stream, "ts", ("k",), "5 minutes"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).columns == ["begin", "finish", "k", "n"]
    assert {r["n"] for r in spark.table("tumbling").collect()} <= {5}


def test_counters_with_the_same_keys(spark):
    """They are counted in one row, and as one by one; the query reads its sums once."""
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), (None, 3, 7), ("b", 4, 1), ("b", None, 2)], "k string, n int, v int")
    keys = {"k": F.col("k")}
    every = {
        "all": counters.Counter(keys, {"n": F.lit(1), "v": F.col("v")}), "some": counters.Counter(keys, {"v": F.col("v")}, F.col("n") >= 2),
        "other": counters.Counter({"n": F.col("n")}, {"v": F.col("v")}, F.col("v") > 1),
    }
    assert counters.alike(every) == [["all", "some"], ["other"]]
    got = {n: sorted(map(repr, t.collect())) for n, t in counters.told_apart(counters.count_once(df, every), every).items()}
    for name, c in every.items():
        alone = counters.told_apart(counters.count_once(df, {name: c}), {name: c})[name]
        rows = df if c.where is None else df.where(c.where)
        plain = rows.groupBy(*[v.alias(k) for k, v in c.keys.items()]).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in c.sums.items()])
        assert got[name] == sorted(map(repr, alone.collect())) == sorted(map(repr, plain.collect()))
    from cytomill.plans import queries

    query = queries.counters_of_one_pass(spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 2
    spark.catalog.clearCache()

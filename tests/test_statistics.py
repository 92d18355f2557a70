"""Bias statistics, cutting sites, plateaus, aggregation specs, configuration."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomill import cli, config
from cytomill.functions import columns as C
from cytomill.operators import aggspec, mbias, plateau, sites


def test_binomial_cdf_is_exact():
    for n in (1, 7, 50, 400):
        for p in (0.001, 0.3, 0.5, 0.97):
            f = Fraction(p)
            for k in sorted({0, n // 3, n // 2, n - 1, n}):
                want = float(sum(comb(n, i) * f**i * (1 - f) ** (n - i) for i in range(k + 1)))
                assert plateau.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-290)
    assert np.isnan(plateau.binomial_cdf(1, 2, 1.5)) and plateau.binomial_cdf(0, 0, 0.3) == 1
    assert plateau.p_values(0, 0, 0.5) == 0


def curve(shape, seen, n=101, seed=0):
    """Proportions by position: a plateau of 0.7 with biased ends."""
    p = np.full(n, 0.7)
    if shape == "ends":
        p[:10], p[90:] = 0.3, 0.9
    if shape == "slope":
        p = 0.65 + 0.0005 * np.arange(n)
    return np.random.default_rng(seed).binomial(seen, p).astype(float)


def line_of(spark, meth, seen):
    return spark.createDataFrame([(i + 1, int(k), int(n)) for i, (k, n) in enumerate(zip(meth, seen, strict=True))], "pos long, n_meth long, n_total long")


def grid(meth, seen, cfg):
    """Every model of the grid tried at every position: the first with most positions within their ranges."""
    x = np.arange(len(meth))
    beta = np.where(seen > 0, meth / np.maximum(seen, 1), np.nan)
    middle = float(np.nanmedian(beta))
    low, high = plateau.accepted_range(meth, seen, cfg.always_accept)
    model = np.clip(np.linspace(middle - 0.1, middle + 0.1, cfg.steps)[:, None, None] + np.linspace(0, cfg.max_slope, cfg.steps)[None, :, None] * x, 0, 1)
    n = ((model >= low) & (model <= high)).sum(2)
    return (*np.unravel_index(int(n.argmax()), n.shape), int(n.max()))


@pytest.mark.parametrize("seen", [500, 2000])
@pytest.mark.parametrize("shape", ["flat", "ends", "slope"])
def test_plateau_height(spark, shape, seen):
    meth, n = curve(shape, seen), np.full(101, float(seen))
    cfg = plateau.PlateauConfig(steps=60)
    line = line_of(spark, meth, n)
    a, b = plateau.sloped_plateau(line, cfg)
    assert plateau.best_line(line, cfg)[1:] == (*grid(meth, n, cfg), 101)
    middle = 0.675 if shape == "slope" else 0.7
    assert abs(a - middle) < (0.02 if seen == 2000 else 0.06) and 0 <= b <= 0.0006  # with few reads many lines fit all positions; the first of them counts
    if shape != "slope":
        assert abs(plateau.flat_plateau(line) - 0.7) < 0.02


@pytest.mark.parametrize("height", [0.01, 0.5, 0.97])
def test_sweep_equals_every_model_of_the_grid(spark, height):
    """Steep lines, positions without counts or with few, models beyond 0 and 1."""
    rng = np.random.default_rng(3)
    for cfg in (plateau.PlateauConfig(steps=37, max_slope=0.01), plateau.PlateauConfig(steps=1), plateau.PlateauConfig(steps=20, max_slope=0.0, always_accept=0.001)):
        seen = rng.choice([0.0, 3.0, 40.0, 4000.0], 30)
        meth = rng.binomial(seen.astype(int), np.clip(height + 0.004 * np.arange(30), 0, 1)).astype(float)
        _, i, j, n, size = plateau.best_line(line_of(spark, meth, seen), cfg)
        assert (i, j, n) == grid(meth, seen, cfg) and size == 30


def test_no_plateau(spark):
    meth = np.where(np.arange(40) % 2, 900.0, 100.0)
    line = line_of(spark, meth, np.full(40, 1000.0))
    for search in (lambda: plateau.sloped_plateau(line, plateau.PlateauConfig(steps=20)), lambda: plateau.flat_plateau(line)):
        with pytest.raises(ValueError):
            search()
    with pytest.raises(ValueError):
        plateau.sloped_plateau(line.where("pos < 0"), plateau.PlateauConfig())


def test_accepted_range_equals_grid():
    meth, n = curve("ends", 500), np.full(101, 500.0)
    lo, hi = plateau.accepted_range(meth, n, 0.02)
    with np.errstate(divide="ignore"):
        for m in np.linspace(0.05, 0.95, 40):
            brute = (np.log10(plateau.p_values(meth, n, np.full(101, m))) > -8) | (np.abs(meth / n - m) < 0.02)
            assert (((lo <= m) & (m <= hi)) == brute).mean() > 0.99


@pytest.mark.parametrize(("bad", "flen", "want"), [
    ([], 200, (0, 101)), (range(10), 200, (10, 101)), (range(90, 101), 200, (0, 90)), ([*range(5), *range(96, 101)], 200, (5, 96)),
    (range(101), 200, (0, 0)), ([3], 200, (0, 101)), (range(40, 101), 60, (0, 40)), ([0, 3], 200, (4, 101)),
])
def test_breakpoints(bad, flen, want):
    p = np.ones(101)
    p[list(bad)] = 0
    assert plateau.breakpoints(p, flen) == want


def classic_rows(seen=2000):
    rng = np.random.default_rng(1)
    rows = []
    for strand in ("c_bc", "w_bc"):
        for flen in range(180, 222):
            p = np.full(101, 0.7)
            p[:9] = 0.2
            k = rng.binomial(seen, p)
            rows += [("CG", strand, flen, pos + 1, int(k[pos]), int(seen - k[pos])) for pos in range(101)]
    return rows


def test_detection(spark):
    df = spark.createDataFrame(classic_rows(), "motif string, bs_strand string, flen long, pos long, n_meth long, n_unmeth long")
    found = plateau.detect(df, plateau.PlateauConfig(steps=50)).collect()
    assert len(found) == 84 and all((r["start"], r["end"]) == (9, 101) for r in found)
    flat = plateau.detect(df, plateau.PlateauConfig(allow_slope=False)).collect()
    assert np.mean([r["start"] == 9 for r in flat]) > 0.95
    normal = plateau.normal_plateaus(mbias.with_beta(df).where("flen = 200"), max_std=0.05).collect()
    assert all(9 <= r["start"] <= 20 and r["end"] >= 90 for r in normal)


def test_frag_end_sites(spark):
    spec = {"c_bc": (0, 10), "c_bc_rv": (0, 10), "w_bc": (10, 0), "w_bc_rv": (10, 0)}
    got = {(r[0], r[1]): (r[2], r[3]) for r in sites.from_fragment_ends(spark, spec, 101).collect()}
    assert len(got) == 4 * 112 and got["c_bc", 10] == (0, 0) and got["c_bc", 50] == (0, 40) and got["w_bc", 50] == (10, 50) and got["w_bc", 111] == (10, 101) and got["w_bc", 10] == (0, 0)
    with pytest.raises(ValueError):
        sites.from_fragment_ends(spark, {"c_bc": (0, 1)}, 10)


def test_dense_sites(spark):
    df = spark.createDataFrame([(s, f, f // 10, f) for s in C.STRANDS for f in (20, 21, 30, 60)], "bs_strand string, flen long, start long, end long")
    got = {(r[0], r[1]): (r[2], r[3]) for r in sites.dense(df).collect()}
    assert len(got) == 4 * 41 and got["w_bc", 20] == (2, 20) and got["w_bc", 22] == (3, 30) and got["c_bc", 31] == (6, 60)
    with pytest.raises(ValueError):
        sites.check(df.select("flen"))


def test_smoothing(spark):
    rows = [("c_bc", f, 40 if f == 20 else 5, 90 + (f == 30)) for f in range(50)]
    got = {r["flen"]: (r["start"], r["end"]) for r in sites.smoothed(spark.createDataFrame(rows, "bs_strand string, flen long, start long, end long")).collect()}
    assert set(got.values()) == {(5, 90)}


def stats_table(spark):
    rows = [(m, s, f, p, f + p, 2 * p) for m in ("CG", "CHH") for s in ("c_bc", "w_bc") for f in (50, 60) for p in (1, 2)]
    return mbias.with_beta(spark.createDataFrame(rows, "motif string, bs_strand string, flen long, pos long, n_meth long, n_unmeth long"))


def test_cube_filters(spark):
    rows = [("w_bc", 100, 30, 5, 8, "AACGT"), ("w_bc", 100, 30, 5, 8, "TACGA"), ("w_bc", 100, 30, 5, 4, "AACGT"), ("w_bc", 100, 30, 5, 2, "AACGT"), ("w_bc", 100, 30, 5, 8, "AANGT"), (None, 100, 30, 5, 8, "AACGT"), ("w_bc", -9999, 99, 5, 8, "AACGT")]
    df = spark.createDataFrame(rows, "bs_strand string, tlen long, phred int, pos_in_read int, status int, seq_context string")
    got = {tuple(r)[:6]: r[6] for r in mbias.count_cube(df).collect()}
    assert got == {("WWCGW", "w_bc", 100, 34, 6, "n_meth"): 2, ("WWCGW", "w_bc", 100, 34, 6, "n_unmeth"): 1, ("WWCGW", "w_bc", 500, 40, 6, "n_meth"): 1}


def test_masking(spark):
    cut = spark.createDataFrame([(s, f, 1, 9) for s in ("c_bc", "w_bc") for f in (50, 60)], "bs_strand string, flen long, start long, end long")
    got = {(r["pos"], r["n_meth"] is None, r["beta_value"] is None) for r in mbias.masked(stats_table(spark), cut).collect()}
    assert got == {(1, True, True), (2, False, False)}
    with pytest.raises(Exception, match="no cutting site"):
        mbias.masked(stats_table(spark), cut.where("flen = 50")).collect()


def test_impossible_positions(spark):
    df = spark.createDataFrame([(5, p) for p in range(1, 8)], "flen long, pos long")
    assert sorted(r["pos"] for r in mbias.possible(df).collect()) == [1, 2, 3, 4]


def test_aggregate_table(spark):
    df = stats_table(spark)
    got = sorted(map(tuple, aggspec.aggregate_table(df, {"pos", "motif"}, {"bs_strand": ["c_bc"]}).collect()))
    assert got == [("CG", 1, 112, 4, 112 / 116), ("CG", 2, 114, 8, 114 / 122), ("CHH", 1, 112, 4, 112 / 116), ("CHH", 2, 114, 8, 114 / 122)]
    for args in (({"nothing"}, None), ({"pos"}, {"nothing": [1]})):
        with pytest.raises(ValueError):
            aggspec.aggregate_table(df, *args)


SPEC = {
    "defaults": {"plot_params": {"width": 1}, "datasets": ["full"], "pre_agg_filters": {"motif": ["CG"]}},
    "beta": {"aes_mappings": [{"x": "pos", "y": "beta_value", "color": "bs_strand", "detail": ["flen"]}, {"x": "pos", "y": "beta_value", "row": "dataset"}], "datasets": [["full", "other"], "full"]},
}


def test_specs(spark):
    found = aggspec.plot_configs(SPEC, ["full", "other"])
    assert len(found) == 4 and found[0].mapping.variables() == {"pos", "bs_strand", "flen"} and found[0].pre == (("motif", ("CG",)),)
    done = aggspec.aggregates(found, {"full": stats_table(spark), "other": stats_table(spark)})
    assert len(done) == 4 and len({t.digest() for t in done}) == 4
    data = aggspec.plot_data(found[1], done) if len(found[1].datasets) > 1 else aggspec.plot_data(found[0], done)
    assert {r["dataset"] for r in data.select("dataset").distinct().collect()} == {"full", "other"}
    assert aggspec.chart(found[0], aggspec.plot_data(found[0], done))["encoding"]["color"]["type"] == "nominal"
    with pytest.raises(ValueError):
        aggspec.plot_configs({"g": {"datasets": ["full"]}})
    bad = aggspec.post_filter(stats_table(spark), {"motif": ["CG", "XX"]})  # lazy: no job runs before the rows are read
    with pytest.raises(Exception, match="motif has no XX"):
        bad.collect()
    with pytest.raises(TypeError):
        aggspec.post_filter(stats_table(spark), {"nothing": "CG"})
    assert aggspec.post_filter(stats_table(spark), {"motif": ["CG"], "absent": [1]}).count() == 8
    assert stats_table(spark).where(aggspec.selection(motif="CG", flen=slice(55, None), pos=[1])).count() == 2


def test_no_job_runs_while_a_chart_is_planned(spark):
    found = aggspec.plot_configs(SPEC, ["full", "other"])
    table = stats_table(spark)
    spark.sparkContext.setJobGroup("planned", "")
    done = aggspec.aggregates(found, {"full": table, "other": table})
    for c in found:
        aggspec.post_filter(aggspec.plot_data(c, done), {"motif": ["CG"]})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_chart_parameters(spark):
    params = {"y_axis": {"share": False, "breaks": [0, 0.5, 1], "limits": [0, 1]}, "panel_width_cm": 10, "plot": ["line", "point"], "theme": "talk", "background": "white"}
    c = aggspec.line_chart(stats_table(spark), {"x": "pos", "y": "beta_value", "color": "bs_strand"}, "t", params)
    assert c["encoding"]["y"]["axis"]["values"] == [0, 0.5, 1] and c["encoding"]["y"]["scale"]["domain"] == [0, 1] and c["resolve"]["scale"] == {"x": "shared", "y": "independent"}
    assert c["width"] == 378 and c["mark"]["point"] and c["config"]["background"] == "white" and c["config"]["axis"]["labelFontSize"] == 16
    frame = aggspec.plot_frame(stats_table(spark), aggspec.Mapping2D("pos", "beta_value", color="flen"), [50])
    assert {r["flen"] for r in frame.collect()} == {50} and frame.count() == 2
    with pytest.raises(ValueError):
        aggspec.line_chart(stats_table(spark), {"x": "pos", "y": "beta_value"}, "t", max_rows=3)


def test_binomial_cdf_of_many_counts():
    """At half of the probability mass the normal law is close; tails against the logarithm of exact terms."""
    for n in (10**4, 10**6, 10**8, 10**10):
        k = np.array([0.7 * n])
        assert plateau.binomial_cdf(k, n, 0.7)[0] == pytest.approx(0.5, abs=0.6 / np.sqrt(n)) and plateau.binomial_cdf(k, n, 0.7)[0] > 0.5
        sd = np.sqrt(n * 0.21)
        low, high = plateau.binomial_cdf(k - 5 * sd, n, 0.7)[0], 1 - plateau.binomial_cdf(k + 5 * sd, n, 0.7)[0]
        assert 1.5e-7 < low < 6e-7 and 1.5e-7 < high < 6e-7
        assert plateau.binomial_cdf(k - 100 * sd, n, 0.7)[0] < 1e-80 and plateau.binomial_cdf(k + 40 * sd, n, 0.7)[0] == 1
    n, p = 40_000, 0.4
    f = Fraction(2, 5)
    for k in (15_600, 15_990, 16_300):
        terms = np.array([plateau._lgamma(n + 1) - plateau._lgamma(i + 1) - plateau._lgamma(n - i + 1) + i * np.log(float(f)) + (n - i) * np.log(1 - float(f)) for i in range(k + 1)])
        assert plateau.binomial_cdf(k, n, p) == pytest.approx(np.exp(terms).sum(), rel=1e-7)
    few = plateau.binomial_cdf(np.array([3.0, 0.0, 10.0**9 - 3]), 10**9, np.array([3e-9, 1e-9, 1 - 3e-9]))
    assert few == pytest.approx([0.6472318887822313, 0.36787944117, 0.5768099188731565], rel=1e-5)


def test_cut_ends_equal_breakpoints(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for flen in range(1, 130):
        p = np.where(rng.random(101) < 0.06, rng.choice([0.0, 1e-9, 0.05], 101), 0.8)
        p[: rng.integers(0, 15)] = 0
        p[101 - rng.integers(0, 15) :] = 0
        gone = rng.random(101) < 0.02
        want["w_bc", flen] = plateau.breakpoints(np.where(gone, 0, p), flen)
        rows += [("w_bc", flen, i + 1, float(p[i])) for i in range(101) if not gone[i]]
    got = plateau.cut_ends(spark.createDataFrame(rows, "bs_strand string, flen long, pos long, p double"), 1, 101).collect()
    assert {(r["bs_strand"], r["flen"]): (r["start"], r["end"]) for r in got} == want


def test_phred_thresholds_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [("CG", "Mate 1", "w_bc", int(f), int(q), int(pos), int(a), int(b)) for f in (50, 60) for q in (4, 9, 14, 19) for pos in (1, 2, 3) for a, b in [rng.integers(0, 9, 2)] if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "motif string, mate string, bs_strand string, flen long, phred long, pos long, n_meth long, n_unmeth long")
    levels = sorted({r[4] for r in rows})
    want = {(pos, q): tuple(sum(r[i] for r in rows if r[5] == pos and r[4] > q) for i in (6, 7)) for pos in {r[5] for r in rows} for q in levels[:-2]}
    assert {(r["pos"], r["phred"]): (r["n_meth"], r["n_unmeth"]) for r in mbias.phred_thresholds(df).collect()} == want


def executed(df):
    """The plan as it ran, without the one it began as."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_bias_tables_share_exchanges(spark, tmp_path):
    """Statistics shuffle reads once; thresholds and post filters read what is already shuffled."""
    rows = [("CG", "ATCGA", "w_bc" if i % 2 else "c_bc", 120, i % 40, i % 50, 8 if i % 3 else 4) for i in range(500)]
    spark.createDataFrame(rows, "motif string, seq_context string, bs_strand string, tlen int, phred int, pos_in_read int, status int").write.parquet(str(tmp_path / "r"))
    stats = mbias.stats(mbias.count_cube(spark.read.parquet(str(tmp_path / "r"))))
    assert executed(stats).count("Exchange hashpartitioning") == 1
    assert "ReusedExchange" in executed(mbias.phred_thresholds(stats))
    kept = aggspec.post_filter(aggspec.aggregate_table(stats, {"bs_strand", "pos"}), {"bs_strand": ["w_bc"]})
    assert "ReusedExchange" in executed(kept) and {r["bs_strand"] for r in kept.collect()} == {"w_bc"}
    with pytest.raises(Exception, match="bs_strand has no c_bc_rv"):
        aggspec.post_filter(aggspec.aggregate_table(stats, {"bs_strand"}), {"bs_strand": ["w_bc", "c_bc_rv"]}).collect()


def test_motifs_of_every_context(spark):
    letters = "ACGTW"
    df = spark.createDataFrame([(f"W{a}C{b}{c}",) for a in "A" for b in letters for c in letters], "context string")
    want = {r["context"]: "CG" if r["context"][3] == "G" else "CH" + ("G" if r["context"][4] == "G" else "H") for r in df.collect()}
    assert {r["context"]: r["motif"] for r in df.select("context", C.motif_of_context(F.col("context"), 5).alias("motif")).collect()} == want


def test_choice_of_plateau_detection():
    assert cli.plateau_config('{"algorithm": "normal"}') is None and cli.plateau_config('{"algorithm": "binomial"}') == plateau.PlateauConfig()
    for bad in ('{"algorithm": "other"}', '{"algorithm": "normal", "max_slope": 1}', '{"algorithm": 1}'):
        with pytest.raises(ValueError):
            cli.plateau_config(bad)


def test_default_parameters():
    d = config.DEFAULTS
    assert d["stats"] == {"seq_context_size": 5, "max_flen_with_single_flen_resolution": 150, "flen_bin_size": 20, "max_flen": 500, "phred_bin_size": 5, "max_phred": 40}
    assert d["basic_quality_filtering"] == {"min_mapq": 25, "min_phred_score": 25} and d["coverage_analysis"] == {"max_per_motif_cov": 80}
    assert d["trimming"]["min_plateau_perc"] == 0.5 and d["trimming"]["min_flen_considered_for_trimming"] == 50 and d["trimming"]["max_std_within_plateau"] == 0.02
    s = d["stats"]
    assert mbias.Binning() == mbias.Binning(s["seq_context_size"], s["max_flen_with_single_flen_resolution"], s["flen_bin_size"], s["max_flen"], s["phred_bin_size"], s["max_phred"])
    assert config.trimming("frag_end") == ("frag_end", {"w_bc": (0, 9), "c_bc": (0, 9), "w_bc_rv": (9, 0), "c_bc_rv": (9, 0)})
    assert config.selected("{a}/{b}_{c}", a="x", b=["1", "2"]) == ["x/1_{c}", "x/2_{c}"] and config.selected("{a}", a="y") == "y"


def test_configuration(tmp_path):
    user = tmp_path / "c.toml"
    user.write_text("[stats]\nmax_flen = 300\n")
    c = config.assemble(config.sample_info("s1", output_dir="/out"), None, str(user))
    assert c["stats"]["max_flen"] == 300 and c["paths"]["calls"] == "/out/meth_calls/s1"
    with pytest.raises(KeyError):
        config.merged({"a": 1}, {"b": 1})
    with pytest.raises(TypeError):
        config.merged({"a": 1}, {"a": "x"})
    with pytest.raises(KeyError):
        config.merged({"a": {"b": 1}}, {"a": {"c": 1}}, allow_new_keys=True)
    assert config.trimming('frag_end::{"w_bc": [0, 5]}') == ("frag_end", {"w_bc": (0, 5)})
    with pytest.raises(NotImplementedError):
        config.trimming("read_end::x")
    assert config.named_paths("a=1,b=x=y") == {"a": "1", "b": "x=y"} and config.subset("a", {"a": 1, "b": 2}) == {"a": 1}
    with pytest.raises(ValueError):
        cli.plateau_config("{}")


def test_any_number_of_aggregates_takes_one_scan(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["CG", "CHH"]), rng.choice(C.STRANDS), rng.choice([50, 60, 70]), rng.randint(1, 5), rng.choice([None, rng.randint(0, 9)]), rng.randint(0, 9), None) for _ in range(400)]
    df = spark.createDataFrame(rows, "motif string, bs_strand string, flen long, pos long, n_meth long, n_unmeth long, beta_value double")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tasks = [aggspec.Task("d", frozenset(v), f) for v, f in ((("pos",), ()), (("pos", "bs_strand"), (("motif", ("CG",)),)), (("motif", "flen"), (("flen", (50, 70)), ("pos", (1, 2)))), ((), ()), (("motif", "pos", "flen", "bs_strand"), ()))]
    done = aggspec.rolled(df, tasks)
    for t in tasks:
        got, want = aggspec.of_task(done, tasks, t, df.columns), aggspec.aggregate_table(df, t.variables, dict(t.filters))
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    done.collect()
    assert done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1
    with pytest.raises(ValueError):
        aggspec.rolled(df, [aggspec.Task("d", frozenset(["nothing"]))])

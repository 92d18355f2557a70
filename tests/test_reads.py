"""Read-level columns, filters, calls and writers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cytomill.functions import columns as C
from cytomill.operators import calls, filters, pileup, sites
from cytomill.sources import sam, writers

READ = "chrom string, start int, motif string, read_name string, file_ord int, bs_strand string, is_read1 boolean, mapq int, tlen long, phred int, pos_in_read int, status int"


def reads(spark, rows):
    """(name, phred, status) and overrides."""
    base = {"chrom": "1", "start": 5, "motif": "CG", "bs_strand": "w_bc", "is_read1": True, "mapq": 60, "tlen": 100, "pos_in_read": 10}
    full = [{**base, "read_name": n, "phred": p, "status": s, "file_ord": i, **more} for i, (n, p, s, more) in enumerate(rows)]
    names = [f.split()[0] for f in READ.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in full], READ)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_strands(spark):
    want = {99: "w_bc", 147: "w_bc_rv", 83: "c_bc", 163: "c_bc_rv", 0: None, 240: "c_bc"}
    assert {f: one(spark, C.bs_strand(F.lit(f))) for f in want} == want
    assert [one(spark, C.flags_ok(F.lit(f))) for f in (99, 1123, 65, 2147, 355)] == [True, False, False, False, False]


def test_statuses(spark):
    want = {"w_bc": {("C", "C"): 8, ("T", "C"): 4, ("A", "C"): 2, ("G", "G"): 1, ("A", "G"): 2, ("N", "C"): 16}, "c_bc_rv": {("G", "G"): 8, ("A", "G"): 4, ("C", "G"): 2, ("C", "C"): 1, ("T", "C"): 2, ("N", "G"): 16}}
    for strand, table in want.items():
        assert {k: one(spark, C.meth_status(F.lit(k[0]), F.lit(k[1]), F.lit(strand))) for k in table} == table
    assert one(spark, C.meth_status(F.lit("C"), F.lit("C"), F.lit(None).cast("string"))) == 16


def test_motif_truth_table(spark):
    want = {"WWCGW": "CG", "GGCWG": "CHG", "CCCCG": "CHG", "CCCCC": "CHH", "WWCWW": "CHH", "GGCGG": "CG"}
    assert {k: one(spark, C.motif_of_context(F.lit(k), 5)) for k in want} == want
    assert [one(spark, C.motif_of_context(F.lit(k), 3)) for k in ("WCG", "WCW")] == ["CG", "CH"]
    assert [one(spark, C.motif_of_context(F.lit(k), 5, False)) for k in ("WWCGW", "WWCWG", "CCCCC")] == ["CGW", "CWG", "CCC"]
    assert [one(spark, C.context_bin(F.lit(k), 5)) for k in ("ATCGG", "ATNGG", "ATG", "ATTGG")] == ["WWCGG", None, None, None]
    with pytest.raises(ValueError):
        C.context_bin(F.lit("AC"), 4)


def test_bins(spark):
    assert [one(spark, C.flen_bin(F.lit(t), 5, 2, 10)) for t in (0, 5, 6, 7, -8, 9, 10, 11)] == [0, 5, 7, 7, 9, 9, 10, 10]
    assert [one(spark, C.phred_bin(F.lit(q), 5, 10)) for q in (0, 4, 5, 9, 10, 11)] == [4, 4, 9, 9, 10, 10]


def test_number_format(spark):
    want = {(1, 512): "0.00195312", (1, 3): "0.33333333", (0, 5): "0.00000000", (5, 5): "1.00000000"}
    assert {k: one(spark, C.fixed8(C.ratio(F.lit(k[0]), F.lit(k[1])))) for k in want} == want
    assert one(spark, C.fixed8(C.ratio(F.lit(0), F.lit(0)))) == "nan"


def test_trimming(spark):
    s = sites.from_fragment_ends(spark, {x: (0, 10) if x == "w_bc" else (5, 0) for x in C.STRANDS}, 101)
    rows = [(str(i), 30, 8, {"bs_strand": b, "tlen": t, "pos_in_read": p}) for i, (b, t, p) in enumerate([("w_bc", 100, 89), ("w_bc", 100, 90), ("w_bc", -5000, 100), ("c_bc", 50, 4), ("c_bc", 50, 5), ("c_bc", 3, 0)])]
    assert {r["read_name"] for r in filters.trim(reads(spark, rows), s, 111).collect()} == {"0", "2", "4"}


def test_overlap_rules(spark):
    rows = [
        ("alone", 30, 8, {}), ("agree", 20, 8, {}), ("agree", 30, 8, {}), ("tie", 30, 4, {}), ("tie", 30, 4, {}), ("differ", 30, 8, {}), ("differ", 10, 4, {}),
        ("three", 9, 8, {}), ("three", 8, 4, {}), ("three", 7, 8, {}), ("snp", 30, 2, {}), ("snp", 20, 8, {}), ("na", 30, 16, {}), ("na", 20, 8, {}), ("agree", 40, 8, {"start": 6}),
    ]
    got = {(r["read_name"], r["file_ord"]): r["overlap"] for r in filters.overlap(reads(spark, rows)).collect()}
    assert got == {("alone", 0): False, ("agree", 1): True, ("agree", 2): False, ("tie", 3): False, ("tie", 4): True, ("three", 7): False, ("three", 8): False, ("three", 9): False, ("na", 13): False, ("agree", 14): False}


def test_low_quality_takes_part_in_overlap(spark):
    rows = [("x", 5, 8, {}), ("x", 30, 4, {}), ("y", 5, 8, {}), ("z", 30, 8, {"mapq": 3}), ("v", 30, 4, {})]
    r = calls.call(filters.filtered(reads(spark, rows), min_mapq=10, min_phred=20)).first()
    assert (r["n_meth"], r["n_total"], r["beta_value"]) == (0, 1, 0.0)


def test_stratified(spark):
    rows = [("a", 30, 8, {}), ("a", 20, 8, {"bs_strand": "w_bc_rv", "is_read1": False}), ("b", 30, 4, {"bs_strand": "c_bc"}), ("c", 30, 2, {})]
    r = calls.stratified_call(filters.overlap(reads(spark, rows))).first().asDict()
    assert (r["n_meth"], r["n_total"]) == (1, 2) and (r["w_bc_n_meth"], r["w_bc_rv_n_total"], r["c_bc_n_total"], r["c_bc_rv_n_total"]) == (1, 1, 1, 0)
    assert (r["mate1_n_total"], r["mate2_n_meth"], r["c_bc_rv_beta_value"], r["mate1_beta_value"]) == (2, 1, None, 0.5)


CALLED = "chrom string, start int, end int, motif string, score string, strand string, beta_value double, n_meth long, n_total long"


def test_merging(spark):
    df = spark.createDataFrame([("1", 10, 11, "CG", ".", "+", 0.5, 1, 2), ("1", 11, 12, "CG", ".", "-", 1.0, 2, 2), ("1", 20, 21, "CG", ".", "-", None, 0, 0), ("1", 30, 31, "CG", ".", "+", 0.0, 0, 4), ("1", 31, 32, "CG", ".", "-", 0.25, 1, 4)], CALLED)
    got = sorted(map(tuple, calls.merge_strands(df).collect()), key=lambda r: r[1])
    assert got == [("1", 10, 12, "CG", ".", "+", 0.75, 3, 4), ("1", 20, 21, "CG", ".", "-", None, 0, 0), ("1", 30, 32, "CG", ".", "+", 0.125, 1, 8)]
    lines = sorted((r["start"], r["end"], r["n_meth"], r["n_total"]) for r in calls.merge_lines(df).collect())
    assert lines == [(10, 12, 3, 4), (20, 31, 0, 4)]


def test_coverage(spark):
    df = spark.createDataFrame([("CG", 0), ("CG", 2), ("CG", 9), ("CG", 10), ("CHH", 1)], "motif string, n_total long")
    got = {(r[0], r[1]): r[2] for r in calls.coverage_histogram(df, 3).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {("CG", 0): 1, ("CG", 2): 1, ("CG", 3): 2, ("CHH", 1): 1}


def test_lines(spark):
    r = filters.overlap(reads(spark, [("a", 30, 8, {}), ("b", 30, 4, {"motif": "CHG"}), ("c", 30, 2, {}), ("d", 30, 4, {"motif": "CHH"})]))
    assert sorted(x["line"] for x in writers.bismark_lines(r).collect()) == ["a\t+\t1\t5\tZ", "b\t-\t1\t5\tx", "d\t-\t1\t5\th"]
    c = spark.createDataFrame([("1", 10, 11, "CG", ".", "+", 1 / 3, 1, 3), ("1", 12, 13, "CG", ".", "-", None, 0, 0)], CALLED)
    assert [x["line"] for x in writers.bed_lines(c).orderBy("start").collect()] == ["1\t10\t11\tCG\t.\t+\t0.33333333\t1\t3", "1\t12\t13\tCG\t.\t-\tnan\t0\t0"]
    assert len(writers.BED27) == 27
    with pytest.raises(AssertionError):
        writers.check_formats(["bed", "vcf"])


def expand(cigar, pos):
    """(reference place, read place) of aligned letters, letter by letter."""
    import re

    out, r, q = [], pos, 0
    for n, o in re.findall(r"(\d+)(.)", cigar):
        for _ in range(int(n)):
            if o in "M=X":
                out.append((r, q))
            r += o in "MDN=X"
            q += o in "MIS=X"
    return out, q


def test_pileup_equals_letter_by_letter(spark):
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = []
    for i in range(120):
        pos = rng.randint(0, 2800)
        cigar = rng.choice(["50M", "3S20M2D10M1I9M2S", "2H4S30M", "10M100N20M", "5=2X20M", "40M3S4H"])
        places, qlen = expand(cigar, pos)
        seq = [rng.choice("ACGT") for _ in range(qlen)]
        for r, q in places:
            seq[q] = rng.choice([genome[r], "T", "A", "N"]) if r < 3000 else "A"
        rows.append((f"r{i // 2}", rng.choice([99, 147, 83, 163, 1123, 0]), "c", pos, rng.randint(0, 60), cigar, rng.choice([1, 20, 60, -80]), "".join(seq), "".join(chr(33 + rng.randint(2, 40)) for _ in range(qlen)), i))
    idx = [("c", i, i + 1, "CG", ".", "+" if b == "C" else "-") for i, b in enumerate(genome) if b in "CG"]
    a = spark.createDataFrame(rows, sam.SCHEMA)
    got = sorted(map(tuple, pileup.pileup_reads(a, spark.createDataFrame(idx, "chrom string, start long, end long, motif string, score string, strand string")).select("start", "read_name", "file_ord", "bs_strand", "phred", "pos_in_read", "status").collect()))
    strand = {99: "w_bc", 147: "w_bc_rv", 83: "c_bc", 163: "c_bc_rv"}
    want, at = [], {i: s for _, i, _, _, _, s in idx}
    for q, flag, _, pos, _, cigar, tlen, seq, qual, n in rows:
        places, qlen = expand(cigar, pos)
        lead = {"3S20M2D10M1I9M2S": 3, "2H4S30M": 4}.get(cigar, 0)
        tail = {"3S20M2D10M1I9M2S": 2, "40M3S4H": 3}.get(cigar, 0)
        for r, k in places:
            if r not in at or flag not in strand or seq[k] == "N":
                continue
            s = strand[flag]
            p = qlen - (k + 1) - tail if s in ("c_bc", "w_bc_rv") else k - lead
            if p + 1 > abs(tlen):
                continue
            keep, lost, other = ("C", "T", "G") if s.startswith("w") else ("G", "A", "C")
            wb = "C" if at[r] == "+" else "G"
            status = (8 if seq[k] == keep else 4 if seq[k] == lost else 2) if wb == keep else (1 if seq[k] == other else 2)
            want.append((r, q, n, s, ord(qual[k]) - 33, p, status))
    assert got == sorted(want)


def test_interval_join(spark):
    rng = random.Random(2)
    spans = [(i, rng.randint(0, 3), rng.randint(0, 5000), rng.randint(0, 3000)) for i in range(60)]
    points = [(rng.randint(0, 3), rng.randint(0, 8000)) for _ in range(200)]
    got = pileup.interval_join(spark.createDataFrame(spans, "id int, chrom int, start int, len int"), spark.createDataFrame(points, "chrom int, pos int"))
    assert got.count() == sum(c == d and s <= p < s + n for (_, c, s, n), (d, p) in itertools.product(spans, points))


def test_deep_bins_are_dealt_to_tiles(spark):
    """An amplicon: most spans begin at one place, most points are one. No cell holds many more rows than it may."""
    rng = random.Random(3)
    spans = [(i, f"n{i // 2}", 0, 500, 120) for i in range(3000)] + [(i, f"n{i // 2}", rng.randint(0, 1), rng.randint(0, 3000), rng.randint(0, 200)) for i in range(3000, 3300)]
    points = [(0, 510, i) for i in range(400)] + [(rng.randint(0, 1), rng.randint(0, 3200), 1000 + i) for i in range(200)]
    s = spark.createDataFrame(spans, "id int, name string, chrom int, start int, len int")
    p = spark.createDataFrame(points, "chrom int, pos int, point int")
    want = sum(c == d and a <= x < a + n for (_, _, c, a, n), (d, x, _) in itertools.product(spans, points))
    for deal, at_a_place in (("name", 401), (None, 300)):
        got = pileup.interval_join(s, p, width=100, deal=deal, most=150, keep_cell=True).cache()
        assert got.count() == want == got.select("id", "point").distinct().count()
        cells = got.groupBy("chrom", *pileup.CELL).agg(F.countDistinct("id").alias("spans"), F.countDistinct("point").alias("points"))
        top = cells.agg(F.max("spans"), F.max("points"), F.count("*")).first()
        assert top[0] < 300 and top[1] <= at_a_place and top[2] > 20
        # rows of one name and place are in one cell
        assert deal is None or got.groupBy("name", "chrom", "pos").agg(F.countDistinct(*pileup.CELL).alias("n")).where("n > 1").count() == 0
    assert pileup.interval_join(s, p, width=100, most=None).count() == want


def amplicon(n, seed=5):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    rows = []
    for i in range(n):
        first = 200 if i % 3 else rng.randint(0, 400)
        for flag, at in ((99, first), (147, first + rng.randint(0, 60))):
            rows.append((f"r{i}", flag, "c", at, 60, "100M", 150, "".join(rng.choice([genome[k], "T"]) for k in range(at, at + 100)), "".join(chr(33 + rng.randint(2, 40)) for _ in range(100)), len(rows)))
    idx = [("c", i, i + 1, "CG", ".", "+" if b == "C" else "-") for i, b in enumerate(genome) if b in "CG"]
    return rows, idx


def test_mates_of_a_pileup_are_not_shuffled_again(spark):
    """The overlap window works on the partitions of the join: two exchanges, those of reads and positions, and no other."""
    rows, idx = amplicon(150)
    a = spark.createDataFrame(rows, sam.SCHEMA)
    i = spark.createDataFrame(idx, "chrom string, start long, end long, motif string, score string, strand string")
    columns = ["start", "read_name", "file_ord", "phred", "status", "overlap"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (None, 40):
            p = pileup.pileup_reads(a, i, width=100, most=most)
            marked = filters.overlap(p)
            marked.collect()
            plan = marked._jdf.queryExecution().executedPlan().toString()
            final = plan.split("== Initial Plan ==")[0]
            assert final.count("Window ") == 0 or final.count("Exchange hashpartitioning") == 2, final
            assert sum("Window" in line for line in final.splitlines()) >= 1
            plain = filters.overlap(p.drop(*pileup.CELL))
            assert sorted(map(tuple, marked.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_small_index_goes_to_the_reads(spark):
    """Reads are not shuffled without mates; with them they are dealt whole, and only bases that a read of their name may share are sorted."""
    rows, idx = amplicon(60)
    rows += [("r0", 99, "c", 9_990 + i, 60, "5S40M10D15M40S", 150, "a" * 100, "I" * 100, 900 + i) for i in range(2)]  # over the edge of a wide bin
    idx += [("c", i, i + 1, "CG", ".", "-") for i in range(9_980, 10_060)]
    a = spark.createDataFrame(rows, sam.SCHEMA)
    i = spark.createDataFrame(idx, "chrom string, start long, end long, motif string, score string, strand string")
    columns = ["start", "read_name", "file_ord", "phred", "status", "pos_in_read", "overlap"]
    near, cells = pileup.pileup_reads(a, i), pileup.pileup_reads(a, i, width=100)
    want = sorted(map(tuple, filters.overlap(cells).select(columns).collect()))
    assert want == sorted(map(tuple, filters.overlap(near).select(columns).collect())) and {r[-1] for r in want} == {True, False}
    called = [sorted(map(tuple, filters.marked(p, min_phred=10).select(*columns, "called").collect())) for p in (near, cells)]
    assert called[0] == called[1]
    plain = pileup.pileup_reads(a, i, mates=False)
    assert plain.count() == cells.count() and near.where("NOT alone").count() < near.count()
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan


@pytest.mark.parametrize("cigar", ["60M", "5S40M10D15M", "2H3S4M1I5M2N6=1X3S2H", "7S", "3H", "4P5M", "0M3M"])
def test_layout_of_a_cigar(spark, cigar):
    ops = pileup.cigar_ops(F.lit(cigar))
    want = spark.range(1).select(pileup.clip(ops, False), pileup.clip(ops, True), pileup.advance(ops, pileup.IN_REFERENCE), pileup.blocks(ops)).first()
    got = spark.range(1).select(pileup.layout(F.lit(cigar)).alias("x")).select("x.*").first()
    assert tuple(got) == tuple(want)

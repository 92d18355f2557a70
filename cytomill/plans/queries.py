"""The registered queries of the methylation operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggspec, calls, counters, filters, index, mbias, pileup, plateau, sites
from ..sources import writers
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPEC = {"c_bc": (0, 10), "c_bc_rv": (5, 0), "w_bc": (0, 10), "w_bc_rv": (5, 0)}
READ_LENGTH, MAX_FLEN, MIN_MAPQ, MIN_PHRED = 101, 111, 14, 10
BINS = mbias.Binning(context_size=5, max_single_flen=100, flen_width=20, max_flen=300, phred_width=5, max_phred=35)
POS = ("chrom", "start", "motif")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _beta(meth: str = "n_meth", whole: str = "n_total") -> str:
    return f"CASE WHEN {whole} = 0 THEN NULL ELSE {meth}::DOUBLE / {whole} END"


_SPEC = ", ".join(f"('{s}', {a}, {b})" for s, (a, b) in SPEC.items())
SITES = f"""SELECT bs_strand, flen, CASE WHEN a >= least(flen - b, {READ_LENGTH}) THEN 0 ELSE a END::BIGINT AS start,
 CASE WHEN a >= least(flen - b, {READ_LENGTH}) THEN 0 ELSE least(flen - b, {READ_LENGTH}) END::BIGINT AS "end"
 FROM range({MAX_FLEN + 1}) f(flen), (VALUES {_SPEC}) s(bs_strand, a, b)"""
EV = f"ev AS ({views.READS_SQL}), sites AS ({SITES})"
TRIMMED = f"""{EV}, trimmed AS (SELECT ev.* FROM ev JOIN sites s ON ev.bs_strand = s.bs_strand AND least(abs(tlen), {MAX_FLEN}) = s.flen
 WHERE mapq >= {MIN_MAPQ} AND s.start <= pos_in_read AND pos_in_read < s."end")"""
_ORDER = ", ".join(views.ORDER)
OVERLAP = f"""{TRIMMED}, w AS (SELECT *, count(*) OVER g AS n, min(status) OVER g AS lo, max(status) OVER g AS hi, row_number() OVER (PARTITION BY chrom, start, read_name ORDER BY phred DESC, {_ORDER}) AS k
 FROM trimmed WHERE status <> 16 WINDOW g AS (PARTITION BY chrom, start, read_name)),
 marked AS (SELECT *, n = 2 AND k = 2 AS overlap FROM w WHERE NOT (n = 2 AND lo <> hi)), kept AS (SELECT * FROM marked WHERE phred >= {MIN_PHRED})"""


def _count(where: str, prefix: str = "") -> str:
    return f"count(*) FILTER (WHERE {where} AND status = 8) AS {prefix}n_meth, count(*) FILTER (WHERE {where} AND status IN (8, 4)) AS {prefix}n_total"


CALLED = f"{OVERLAP}, called AS (SELECT chrom, start, motif, {_count('NOT overlap')} FROM kept GROUP BY ALL)"
STRATA = {"": "NOT overlap", **{f"{s}_": f"bs_strand = '{s}'" for s in C.STRANDS}, "mate1_": "is_read1", "mate2_": "NOT is_read1"}
STRATIFIED = f"{OVERLAP}, called AS (SELECT chrom, start, motif, {', '.join(_count(w, p) for p, w in STRATA.items())} FROM kept GROUP BY ALL)"


def _sites(spark: SparkSession) -> DataFrame:
    return sites.from_fragment_ends(spark, SPEC, READ_LENGTH)


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered(views.reads(spark, sf_dir), _sites(spark), MAX_FLEN, MIN_MAPQ, MIN_PHRED, order=views.ORDER)


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.call(_filtered(spark, sf_dir))


# genome and index
_INDEX = f"""WITH g AS ({views.GENOME_SQL}), p AS (SELECT chrom, seq, unnest(range(0, length(seq))) AS i FROM g),
 b AS (SELECT *, substr(seq, i + 1, 1) AS base FROM p), t AS (SELECT *, CASE WHEN base = 'C' THEN substr(seq, i + 1, 3) ELSE reverse(translate(substr(seq, greatest(i - 1, 1), i + 2 - greatest(i - 1, 1)), 'CGAT', 'GCTA')) END AS triplet FROM b WHERE base IN ('C', 'G')),
 m AS (SELECT *, CASE WHEN length(triplet) < 2 THEN '.' WHEN triplet[2] = 'G' THEN 'CG' WHEN triplet[2] = 'N' THEN 'CN' WHEN length(triplet) < 3 THEN '.' WHEN triplet[3] = 'G' THEN 'CHG' ELSE 'CHH' END AS motif FROM t)
 SELECT chrom, i::BIGINT AS start, (i + 1)::BIGINT AS "end", motif, '.' AS score, CASE WHEN base = 'C' THEN '+' ELSE '-' END AS strand"""


@query(f"{_INDEX} FROM m WHERE motif IN ('CG', 'CHG', 'CHH')")
def motif_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.motif_index(views.genome(spark, sf_dir), C.MOTIFS)


@query(
    f"""{_INDEX}, rpad(triplet, 3, '$') AS triplet_seq, CASE WHEN i >= 2 AND i + 2 < length(seq) THEN CASE WHEN base = 'C' THEN substr(seq, i - 1, 5) ELSE reverse(translate(substr(seq, i - 1, 5), 'CGAT', 'GCTA')) END ELSE '.' END AS seq_context
 FROM m WHERE motif IN ('CG')"""
)
def motif_index_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.motif_index(views.genome(spark, sf_dir), ("CG",), ("triplet_seq", "seq_context"), 2)


@query(f"""WITH g AS ({views.GENOME_SQL}), p AS (SELECT unnest(range(0, length(seq))) AS i, seq, chrom FROM g)
 SELECT chrom, count(*) AS n_letters, count(*) FILTER (WHERE substr(seq, i + 1, 1) = 'N') AS n_unknown FROM p GROUP BY chrom""")
def contig_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.genome(spark, sf_dir).where("core > 0")
    return g.select("chrom", F.length("seq").cast("long").alias("n_letters"), (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).cast("long").alias("n_unknown"))


# read-level columns
_FLAG = "CAST(CASE l_suppkey % 8 WHEN 0 THEN 99 WHEN 1 THEN 83 WHEN 2 THEN 163 WHEN 3 THEN 147 WHEN 4 THEN 1123 WHEN 5 THEN 65 WHEN 6 THEN 337 ELSE 4 END AS INT)"


@query(f"""SELECT flag, CASE WHEN flag & 80 = 80 THEN 'c_bc' WHEN flag & 160 = 160 THEN 'c_bc_rv' WHEN flag & 96 = 96 THEN 'w_bc' WHEN flag & 144 = 144 THEN 'w_bc_rv' END AS bs_strand,
 flag & 3 = 3 AND flag & 3852 = 0 AS flags_ok, count(*) AS n FROM (SELECT {_FLAG} AS flag FROM lineitem) GROUP BY ALL""")
def bs_strand_from_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.table(spark, sf_dir, "lineitem").selectExpr(f"{_FLAG} as flag")
    return f.groupBy("flag", C.bs_strand(F.col("flag")).alias("bs_strand"), C.flags_ok(F.col("flag")).alias("flags_ok")).agg(F.count("*").alias("n"))


_BASE = "substr('ACGTN', CAST(round(l_discount * 100) AS INT) % 5 + 1, 1)"
_WATSON = "CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'G' END"


@query(f"""WITH r AS (SELECT bs_strand, {_BASE} AS base, {_WATSON} AS wb FROM ({views.READS_SQL}) v)
 SELECT bs_strand, base, wb AS watson_base, CASE WHEN base = 'N' THEN 16 WHEN bs_strand IN ('w_bc', 'w_bc_rv') THEN CASE WHEN wb = 'C' THEN CASE base WHEN 'C' THEN 8 WHEN 'T' THEN 4 ELSE 2 END WHEN base = 'G' THEN 1 ELSE 2 END
 ELSE CASE WHEN wb = 'G' THEN CASE base WHEN 'G' THEN 8 WHEN 'A' THEN 4 ELSE 2 END WHEN base = 'C' THEN 1 ELSE 2 END END AS status, count(*) AS n FROM r GROUP BY ALL""")
def meth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reads(spark, sf_dir).selectExpr("bs_strand", f"{_BASE} as base", f"{_WATSON} as watson_base")
    return r.groupBy("bs_strand", "base", "watson_base", C.meth_status(F.col("base"), F.col("watson_base"), F.col("bs_strand")).alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT bs_strand, pos_in_read AS q, tlen, l_linenumber % 4 AS a, l_linenumber % 3 AS b FROM ({views.READS_SQL}) v),
 p AS (SELECT *, (CASE WHEN bs_strand IN ('c_bc', 'w_bc_rv') THEN 101 - (q + 1) - b ELSE q - a END)::INT AS pos FROM r)
 SELECT bs_strand, pos AS pos_in_read, pos + 1 <= abs(tlen) AS inside, a < q + 1 AND q + 1 < 101 - b + 1 AS unclipped, count(*) AS n FROM p GROUP BY ALL""")
def pos_in_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reads(spark, sf_dir).select("bs_strand", F.col("pos_in_read").alias("q"), "tlen", (F.col("l_linenumber") % 4).alias("a"), (F.col("l_linenumber") % 3).alias("b"))
    n = F.lit(101)
    r = r.withColumn("pos_in_read", C.pos_in_read(F.col("bs_strand"), F.col("q"), n, F.col("a"), F.col("b")).cast("int"))
    inside, clear = C.within_fragment(F.col("pos_in_read"), F.col("tlen")), C.outside_clips(F.col("q"), n, F.col("a"), F.col("b"))
    return r.groupBy("bs_strand", "pos_in_read", inside.alias("inside"), clear.alias("unclipped")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT chrom, start, count(*) AS n FROM ev WHERE mapq >= {MIN_MAPQ} AND phred >= {MIN_PHRED} GROUP BY ALL")
def mapq_phred_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = filters.phred_filter(filters.mapq_filter(views.reads(spark, sf_dir), MIN_MAPQ), MIN_PHRED)
    return r.groupBy("chrom", "start").agg(F.count("*").alias("n"))


# cutting sites and filters
@query(f"""WITH {EV}, s AS ({SITES}) SELECT s.bs_strand, s.flen, s.start, s."end", count(*) AS n FROM s JOIN ev ON ev.bs_strand = s.bs_strand AND least(abs(tlen), {MAX_FLEN}) = s.flen GROUP BY ALL""")
def cutting_sites_frag_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of fixed ends that the reads fall under, and how many."""
    r = views.reads(spark, sf_dir).select("bs_strand", F.least(F.abs("tlen"), F.lit(MAX_FLEN)).alias("flen"))
    return r.join(F.broadcast(_sites(spark)), ["bs_strand", "flen"]).groupBy("bs_strand", "flen", "start", "end").agg(F.count("*").alias("n"))


_SPARSE = "SELECT DISTINCT bs_strand, (tlen // 25) * 25 AS flen FROM ev WHERE tlen < 400"
_SPARSE_SITES = "SELECT bs_strand, flen, flen % 7 AS start, flen % 7 + flen // 2 AS \"end\" FROM sparse"
DENSE = f"""WITH {EV}, sparse AS ({_SPARSE}), known AS ({_SPARSE_SITES}), grid AS (SELECT * FROM (SELECT unnest(generate_series(min(flen), max(flen))) AS flen FROM known), (SELECT DISTINCT bs_strand FROM known))
 SELECT bs_strand, flen, coalesce(first_value(start IGNORE NULLS) OVER o, 0)::BIGINT AS start, coalesce(first_value("end" IGNORE NULLS) OVER o, 0)::BIGINT AS "end"
 FROM grid LEFT JOIN known USING (bs_strand, flen) WINDOW o AS (PARTITION BY bs_strand ORDER BY flen ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def _sparse_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reads(spark, sf_dir).where("tlen < 400").selectExpr("bs_strand", "(tlen div 25) * 25 as flen").distinct()
    return r.selectExpr("bs_strand", "flen", "flen % 7 as start", "flen % 7 + flen div 2 as end")


@query(DENSE)
def cutting_sites_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.dense(_sparse_sites(spark, sf_dir))


_MODE = "(SELECT CASE WHEN count(*) FILTER (WHERE n = top) = 1 AND max(top) >= 3 THEN max(v) FILTER (WHERE n = top) END FROM (SELECT v, n, max(n) OVER () AS top FROM (SELECT v, count(*) AS n FROM unnest({}) u(v) GROUP BY v)))"


#: From ``base`` to ``smooth``.
_SMOOTHING = f"""win AS (SELECT *, list(start) OVER l AS ls, list(start) OVER r AS rs, list("end") OVER l AS le, list("end") OVER r AS re FROM base WINDOW l AS (PARTITION BY bs_strand ORDER BY flen ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY bs_strand ORDER BY flen ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
 modes AS (SELECT *, {_MODE.format("ls")} AS a, {_MODE.format("rs")} AS b, {_MODE.format("le")} AS c, {_MODE.format("re")} AS d FROM win),
 smooth AS (SELECT bs_strand, flen, CASE WHEN a = b THEN a ELSE start END AS start, CASE WHEN c = d THEN c ELSE "end" END AS "end" FROM modes)"""
#: Sites by strand and length as the reads' positions have them: most lengths alike, some apart.
_OBSERVED = "SELECT bs_strand, tlen AS flen, min(pos_in_read) // 12 AS start, max(pos_in_read) // 12 * 12 + 5 - CASE WHEN count(*) % 5 = 0 THEN 70 ELSE 0 END AS \"end\" FROM ev GROUP BY ALL"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.floor(F.min("pos_in_read") / 12), F.floor(F.max("pos_in_read") / 12) * 12 + 5
    found = views.reads(spark, sf_dir).groupBy("bs_strand", F.col("tlen").alias("flen")).agg(low.alias("start"), (high - F.when(F.count("*") % 5 == 0, 70).otherwise(0)).alias("end"))
    return found.select("bs_strand", "flen", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"WITH {EV}, base AS ({_OBSERVED}), {_SMOOTHING} SELECT bs_strand, flen, start::BIGINT AS start, \"end\"::BIGINT AS \"end\" FROM smooth")
def smooth_cutting_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.smoothed(_observed(spark, sf_dir))


@query(f"""WITH {EV}, base AS ({_OBSERVED}) SELECT bs_strand, flen, (CASE WHEN "end" - start < 30 THEN 0 ELSE start END)::BIGINT AS start, (CASE WHEN "end" - start < 30 THEN 0 ELSE "end" END)::BIGINT AS "end" FROM base""")
def least_length_cutting_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.least_length(_observed(spark, sf_dir), 30)


@query(f"""WITH {EV}, base AS ({_OBSERVED}) SELECT bs_strand, flen, cut_end, cut_pos::BIGINT AS cut_pos FROM base UNPIVOT (cut_pos FOR cut_end IN (start, "end"))""")
def cutting_sites_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.plot_table(_observed(spark, sf_dir))


@query(f"WITH {TRIMMED} SELECT chrom, start, bs_strand, count(*) AS n, sum(pos_in_read)::BIGINT AS positions FROM trimmed GROUP BY ALL")
def trim_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = filters.trim(filters.mapq_filter(views.reads(spark, sf_dir), MIN_MAPQ), _sites(spark), MAX_FLEN)
    return r.groupBy("chrom", "start", "bs_strand").agg(F.count("*").alias("n"), F.sum("pos_in_read").alias("positions"))


@query(f"WITH {OVERLAP} SELECT chrom, start, read_name, phred, status, l_linenumber, l_partkey, l_suppkey, overlap FROM marked")
def mate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = filters.overlap(filters.trim(filters.mapq_filter(views.reads(spark, sf_dir), MIN_MAPQ), _sites(spark), MAX_FLEN), order=views.ORDER)
    return r.select("chrom", "start", "read_name", "phred", "status", "l_linenumber", "l_partkey", "l_suppkey", "overlap")


# calls
@query(f"WITH {CALLED} SELECT *, {_beta()} AS beta_value FROM called")
def overlap_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(spark, sf_dir)


@query(f"WITH {STRATIFIED} SELECT *, {', '.join(_beta(f'{p}n_meth', f'{p}n_total') + f' AS {p}beta_value' for p in STRATA)} FROM called")
def stratified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.stratified_call(_filtered(spark, sf_dir))


#: All positions of the view, with the strand that a CG index alternates.
_POSITIONS = """SELECT c.chrom, s.start, (s.start + 1) AS "end", CASE WHEN s.start % 3 = 0 THEN 'CG' WHEN s.start % 3 = 1 THEN 'CHG' ELSE 'CHH' END AS motif, '.' AS score, CASE WHEN s.start % 2 = 0 THEN '+' ELSE '-' END AS strand
 FROM (VALUES ('c0'), ('c1'), ('c2'), ('c3')) c(chrom), (SELECT unnest(range(0, 26))::INT AS start) s"""
ALL_CALLED = f"{CALLED}, idx AS ({_POSITIONS}), every AS (SELECT idx.*, coalesce(n_meth, 0) AS n_meth, coalesce(n_total, 0) AS n_total FROM idx LEFT JOIN called USING (chrom, start, motif))"


def _index(spark: SparkSession) -> DataFrame:
    i = spark.range(26).select(F.col("id").cast("int").alias("start"), F.explode(F.array(*[F.lit(f"c{k}") for k in range(4)])).alias("chrom"))
    m = F.when(F.col("start") % 3 == 0, "CG").when(F.col("start") % 3 == 1, "CHG").otherwise("CHH")
    return i.select("chrom", "start", (F.col("start") + 1).alias("end"), m.alias("motif"), F.lit(".").alias("score"), F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"))


def _all_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.with_all_positions(_index(spark), _called(spark, sf_dir))


@query(f"WITH {ALL_CALLED} SELECT *, {_beta()} AS beta_value FROM every")
def calls_all_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_called(spark, sf_dir)


_FIXED = "CASE WHEN n_total = 0 THEN 'nan' ELSE printf('%.8f', n_meth::DOUBLE / n_total) END"


@query(f"""WITH {ALL_CALLED} SELECT motif, chrom, start, concat_ws(chr(9), chrom, start, "end", motif, '.', strand, {_FIXED}, n_meth, n_total) AS line FROM every""")
def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.bed_lines(_all_called(spark, sf_dir))


_STRATA_TEXT = ", ".join(f"CASE WHEN coalesce({p}n_total, 0) = 0 THEN 'nan' ELSE printf('%.8f', {p}n_meth::DOUBLE / {p}n_total) END, coalesce({p}n_meth, 0), coalesce({p}n_total, 0)" for p in STRATA)


@query(f"""WITH {STRATIFIED}, idx AS ({_POSITIONS}) SELECT motif, chrom, start, concat_ws(chr(9), chrom, start, "end", motif, '.', strand, {_STRATA_TEXT}) AS line FROM idx LEFT JOIN called USING (chrom, start, motif)""")
def stratified_bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.stratified_lines(calls.with_all_positions(_index(spark), calls.stratified_call(_filtered(spark, sf_dir))))


@query(f"""WITH {OVERLAP} SELECT motif, chrom, start, concat_ws(chr(9), read_name, CASE WHEN status = 8 THEN '+' ELSE '-' END, chrom, start,
 CASE motif WHEN 'CG' THEN CASE WHEN status = 8 THEN 'Z' ELSE 'z' END WHEN 'CHG' THEN CASE WHEN status = 8 THEN 'X' ELSE 'x' END ELSE CASE WHEN status = 8 THEN 'H' ELSE 'h' END END) AS line
 FROM kept WHERE NOT overlap AND status IN (8, 4)""")
def bismark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.bismark_lines(_filtered(spark, sf_dir))


@query(f"""WITH {ALL_CALLED}, m AS (SELECT chrom, start - CASE WHEN strand = '-' THEN 1 ELSE 0 END AS k, * EXCLUDE (chrom) FROM every),
 g AS (SELECT chrom, min(start) AS start, max("end") AS "end", arg_min(motif, start) AS motif, '.' AS score, arg_min(strand, start) AS strand, sum(n_meth)::BIGINT AS n_meth, sum(n_total)::BIGINT AS n_total FROM m GROUP BY chrom, k)
 SELECT *, {_beta()} AS beta_value FROM g""")
def merge_strands_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.merge_strands(_all_called(spark, sf_dir))


@query(f"""WITH {ALL_CALLED}, n AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY chrom, start) - 1 AS r FROM every), m AS (SELECT *, r // 2 AS k, count(*) OVER (PARTITION BY motif, r // 2) AS c FROM n),
 g AS (SELECT motif, arg_min(chrom, r) AS chrom, arg_min(start, r) AS start, arg_max("end", r) AS "end", '.' AS score, arg_min(strand, r) AS strand, sum(n_meth)::BIGINT AS n_meth, sum(n_total)::BIGINT AS n_total FROM m WHERE c = 2 GROUP BY motif, k)
 SELECT *, {_beta()} AS beta_value FROM g""")
def merge_strands_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.merge_lines(_all_called(spark, sf_dir), ("chrom", "start"))


@query(f"""WITH {ALL_CALLED}, h AS (SELECT motif, least(n_total, 150) AS coverage, count(*) AS counts FROM every GROUP BY ALL),
 l AS (SELECT * FROM (SELECT unnest(range(0, 151)) AS coverage), (VALUES ('CG'), ('CHG'), ('CHH')) m(motif)) SELECT motif, coverage, coalesce(counts, 0) AS counts FROM l LEFT JOIN h USING (motif, coverage)""")
def coverage_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.coverage_histogram(_all_called(spark, sf_dir), 150)


# bias statistics
_BINNED = """SELECT translate(seq_context, 'AT', 'WW') AS seq_context, bs_strand, CASE WHEN tlen <= 100 THEN tlen WHEN tlen > 300 THEN 300 ELSE least(100 + ceil((tlen - 100) / 20.0) * 20, 300) END::BIGINT AS flen,
 CASE WHEN phred > 35 THEN 35 ELSE least(floor(phred / 5.0) * 5 + 4, 35) END::BIGINT AS phred, (pos_in_read + 1)::BIGINT AS pos, CASE WHEN status = 8 THEN 'n_meth' ELSE 'n_unmeth' END AS meth_status
 FROM ev WHERE status IN (8, 4) AND regexp_matches(seq_context, '^[ACGT][ACGT]C[ACGT][ACGT]$')"""
CUBE = f"{EV}, binned AS ({_BINNED}), cube AS (SELECT seq_context, bs_strand, flen, phred, pos, meth_status, count(*) AS counts FROM binned GROUP BY ALL)"
STATS = f"""{CUBE}, sums AS (SELECT seq_context, bs_strand, flen, phred, pos, coalesce(sum(counts) FILTER (WHERE meth_status = 'n_meth'), 0)::BIGINT AS n_meth, coalesce(sum(counts) FILTER (WHERE meth_status = 'n_unmeth'), 0)::BIGINT AS n_unmeth FROM cube WHERE flen - 1 >= pos GROUP BY ALL),
 stats AS (SELECT CASE WHEN substr(seq_context, 3, 2) = 'CG' THEN 'CG' ELSE 'C' || translate(substr(seq_context, 4, 2), 'ACTW', 'HHHH') END AS motif, seq_context, CASE WHEN bs_strand LIKE '%_rv' THEN 'Mate 2' ELSE 'Mate 1' END AS mate, bs_strand, flen, phred, pos, n_meth, n_unmeth, {_beta("n_meth", "(n_meth + n_unmeth)")} AS beta_value FROM sums)"""
_SUMS = "sum(n_meth)::BIGINT AS n_meth, sum(n_unmeth)::BIGINT AS n_unmeth"
_B = _beta("n_meth", "(n_meth + n_unmeth)")
CLASSIC = f"{STATS}, classic AS (SELECT *, {_B} AS beta_value FROM (SELECT motif, bs_strand, flen, pos, {_SUMS} FROM stats GROUP BY ALL) WHERE flen - 1 >= pos)"


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbias.count_cube(views.reads(spark, sf_dir), BINS)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbias.stats(_cube(spark, sf_dir), BINS.context_size)


@query(f"WITH {CUBE} SELECT * FROM cube")
def mbias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir)


@query(f"""WITH {CUBE}, c AS (SELECT bs_strand, phred, sum(counts)::BIGINT AS counts FROM cube GROUP BY ALL), g AS (SELECT * FROM (VALUES ('c_bc'), ('c_bc_rv'), ('w_bc'), ('w_bc_rv')) s(bs_strand), (SELECT unnest(range(0, 60))::BIGINT AS phred))
 SELECT bs_strand, phred, coalesce(counts, 0)::BIGINT AS counts FROM g LEFT JOIN c USING (bs_strand, phred)""")
def mbias_dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cube(spark, sf_dir).groupBy("bs_strand", "phred").agg(F.sum("counts").alias("counts"))
    return mbias.densify(c, {"bs_strand": mbias.value_levels(spark, "bs_strand", C.STRANDS), "phred": spark.range(60).select(F.col("id").alias("phred"))})


@query(f"WITH {STATS} SELECT * FROM stats")
def mbias_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"WITH {CLASSIC} SELECT * FROM classic")
def mbias_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbias.classic(_stats(spark, sf_dir))


@query(f"WITH {STATS} SELECT 'C' || translate(substr(seq_context, 4, 2), 'AT', 'WW') AS motif, bs_strand, {_SUMS} FROM stats GROUP BY ALL")
def mbias_extended_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mbias.stats(_cube(spark, sf_dir), BINS.context_size, classical=False)
    return mbias.roll_up(s, ("motif", "bs_strand")).drop("beta_value")


@query(f"WITH {STATS}, used AS (SELECT phred FROM stats WHERE bs_strand = 'c_bc' GROUP BY phred HAVING sum(CASE WHEN phred % 10 = 4 THEN 0 ELSE n_meth + n_unmeth END) > 0) SELECT motif, phred, {_SUMS} FROM stats WHERE bs_strand = 'c_bc' AND phred IN (FROM used) GROUP BY ALL")
def mbias_used_phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir).where("bs_strand = 'c_bc'").withColumns({c: F.when(F.col("phred") % 10 == 4, 0).otherwise(F.col(c)) for c in ("n_meth", "n_unmeth")})
    return mbias.roll_up(mbias.used_phred(s), ("motif", "phred")).drop("beta_value")


_BINNED_SITES = f"SELECT bs_strand, flen, CASE WHEN flen < 40 THEN 0 ELSE 5 END AS start, CASE WHEN flen < 40 THEN 0 ELSE least(flen, {READ_LENGTH}) END AS \"end\" FROM (SELECT unnest(range(0, 301)) AS flen), (VALUES ('c_bc'), ('c_bc_rv'), ('w_bc'), ('w_bc_rv')) s(bs_strand)"
MASKED = f"{CLASSIC}, bs AS ({_BINNED_SITES}), masked AS (SELECT motif, bs_strand, flen, pos, CASE WHEN start + 1 <= pos AND pos <= \"end\" THEN n_meth END AS n_meth, CASE WHEN start + 1 <= pos AND pos <= \"end\" THEN n_unmeth END AS n_unmeth, CASE WHEN start + 1 <= pos AND pos <= \"end\" THEN beta_value END AS beta_value FROM classic JOIN bs USING (bs_strand, flen))"


def _binned_sites(spark: SparkSession) -> DataFrame:
    s = spark.range(301).select(F.col("id").alias("flen"), F.explode(F.array(*map(F.lit, C.STRANDS))).alias("bs_strand"))
    none = F.col("flen") < 40
    return s.select("bs_strand", "flen", F.when(none, 0).otherwise(5).alias("start"), F.when(none, 0).otherwise(F.least("flen", F.lit(READ_LENGTH))).alias("end"))


@query(f"WITH {MASKED} SELECT * FROM masked")
def mbias_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbias.masked(mbias.classic(_stats(spark, sf_dir)), _binned_sites(spark))


@query(f"""WITH {STATS}, flat AS (SELECT motif, mate, bs_strand, pos, phred, {_SUMS} FROM stats WHERE motif = 'CG' GROUP BY ALL), levels AS (SELECT DISTINCT phred FROM flat),
 dense AS (SELECT k.*, l.phred, coalesce(n_meth, 0) AS n_meth, coalesce(n_unmeth, 0) AS n_unmeth FROM (SELECT DISTINCT motif, mate, bs_strand, pos FROM flat) k CROSS JOIN levels l LEFT JOIN flat f ON f.motif = k.motif AND f.mate = k.mate AND f.bs_strand = k.bs_strand AND f.pos = k.pos AND f.phred = l.phred),
 above AS (SELECT motif, mate, bs_strand, pos, phred, coalesce(sum(n_meth) OVER w, 0)::BIGINT AS n_meth, coalesce(sum(n_unmeth) OVER w, 0)::BIGINT AS n_unmeth FROM dense WINDOW w AS (PARTITION BY motif, mate, bs_strand, pos ORDER BY phred ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT *, {_B} AS beta_value FROM above WHERE phred NOT IN (SELECT phred FROM levels ORDER BY phred DESC LIMIT 2)""")
def phred_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir)
    return mbias.phred_thresholds(mbias.roll_up(s, [c for c in mbias.INDEX if c != "seq_context"]))


# declarative aggregations
@query(f"WITH {STATS} SELECT *, {_B} AS beta_value FROM (SELECT motif, bs_strand, pos, {_SUMS} FROM stats WHERE flen IN (60, 80, 120) AND motif IN ('CG', 'CHH') GROUP BY ALL)")
def aggregate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggspec.aggregate_table(_stats(spark, sf_dir), {"pos", "bs_strand", "motif"}, {"flen": [60, 80, 120], "motif": ["CG", "CHH"]})


_PLOT = {
    "defaults": {"plot_params": {"width": 200}, "datasets": [["full", "masked"]], "pre_agg_filters": {"motif": ["CG"]}, "post_agg_filters": {"bs_strand": ["c_bc", "w_bc"]}},
    "values": {"aes_mappings": [{"x": "pos", "y": "value", "row": "statistic", "column": "dataset", "color": "bs_strand"}]},
}


@query(f"""WITH {MASKED}, u AS (SELECT 'full' AS dataset, * FROM classic UNION ALL SELECT 'masked', motif, bs_strand, flen, pos, n_meth, n_unmeth, beta_value FROM masked),
 a AS (SELECT dataset, bs_strand, pos, coalesce(sum(n_meth), 0)::DOUBLE AS n_meth, coalesce(sum(n_unmeth), 0)::DOUBLE AS n_unmeth FROM u WHERE motif = 'CG' AND bs_strand IN ('c_bc', 'w_bc') GROUP BY ALL),
 b AS (SELECT *, CASE WHEN n_meth + n_unmeth = 0 THEN NULL ELSE n_meth / (n_meth + n_unmeth) END AS beta_value FROM a) SELECT dataset, bs_strand, pos, statistic, value FROM b UNPIVOT (value FOR statistic IN (n_meth, n_unmeth, beta_value))""")
def union_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = mbias.classic(_stats(spark, sf_dir))
    configs = aggspec.plot_configs(_PLOT, ["full", "masked"])
    done = aggspec.aggregates(configs, {"full": full, "masked": mbias.masked(full, _binned_sites(spark))})
    return aggspec.plot_data(configs[0], done)


# joins and detection
@query("""WITH s AS (SELECT o_orderkey AS span_id, o_custkey % 5 AS chrom, (o_orderkey * 7919) % 100000 AS a, o_custkey % 150 AS len FROM orders), p AS (SELECT DISTINCT l_suppkey % 5 AS chrom, (l_partkey * 104729) % 100000 AS pos FROM lineitem)
 SELECT s.chrom, pos, count(*) AS n_spans, sum(pos - a)::BIGINT AS offsets FROM s JOIN p ON s.chrom = p.chrom AND pos >= a AND pos < a + len GROUP BY ALL""")
def interval_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as span_id", "o_custkey % 5 as chrom", "(o_orderkey * 7919) % 100000 as a", "o_custkey % 150 as len")
    p = views.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 5 as chrom", "(l_partkey * 104729) % 100000 as pos").distinct()
    return pileup.interval_join(s, p, "a", "len", "pos", width=pileup.span_width(s)).groupBy("chrom", "pos").agg(F.count("*").alias("n_spans"), F.sum(F.col("pos") - F.col("a")).alias("offsets"))


# alignments to bases, by CIGAR blocks
PILEUP = f"""a AS ({views.ALIGNMENTS_SQL}), idx AS ({views.POSITIONS_SQL}), kinds(cigar, r, q, n, clip) AS (VALUES ('60M', 0, 0, 60, 0), ('5S40M10D15M', 0, 5, 40, 5), ('5S40M10D15M', 50, 45, 15, 5), ('30M2I28M', 0, 0, 30, 0), ('30M2I28M', 30, 32, 28, 0)),
 met AS (SELECT i.chrom, i.start, i.strand, qname, file_ord, mapq, tlen, k.q + (i.start - pos - k.r) AS q, clip, seq, qual, CASE flag WHEN 99 THEN 'w_bc' WHEN 147 THEN 'w_bc_rv' WHEN 83 THEN 'c_bc' ELSE 'c_bc_rv' END AS bs_strand
  FROM a JOIN kinds k ON k.cigar = a.cigar JOIN idx i ON i.chrom = a.rname AND i.start >= pos + k.r AND i.start < pos + k.r + k.n),
 base AS (SELECT *, substr(seq, (q + 1)::INT, 1) AS base, ascii(substr(qual, (q + 1)::INT, 1)) - 33 AS phred, CASE WHEN strand = '+' THEN 'C' ELSE 'G' END AS wb, CASE WHEN bs_strand IN ('c_bc', 'w_bc_rv') THEN 60 - (q + 1) ELSE q - clip END AS pos_in_read FROM met),
 piled AS (SELECT *, CASE WHEN bs_strand IN ('w_bc', 'w_bc_rv') THEN CASE WHEN wb = 'C' THEN CASE base WHEN 'C' THEN 8 WHEN 'T' THEN 4 ELSE 2 END WHEN base = 'G' THEN 1 ELSE 2 END
  ELSE CASE WHEN wb = 'G' THEN CASE base WHEN 'G' THEN 8 WHEN 'A' THEN 4 ELSE 2 END WHEN base = 'C' THEN 1 ELSE 2 END END AS status FROM base WHERE base <> 'N' AND pos_in_read + 1 <= abs(tlen))"""


def _piled(spark: SparkSession, sf_dir: str, mates: bool = False) -> DataFrame:
    # the given table may be one file of one row group, whose reads a single task would cut into blocks: its rows are dealt while they are narrow
    rows = views.table(spark, sf_dir, "lineitem").select(*views.ALIGNED).repartition("l_orderkey", "l_linenumber")
    return pileup.pileup_reads(rows.selectExpr(*views.ALIGNMENTS), views.positions(spark, sf_dir), mates=mates)


@query(f"WITH {PILEUP} SELECT chrom, start, bs_strand, status, count(*) AS n, sum(phred)::BIGINT AS phreds, sum(pos_in_read)::BIGINT AS positions FROM piled GROUP BY ALL")
def pileup_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of alignments at the index positions."""
    sums = [F.count("*").alias("n"), F.sum("phred").alias("phreds"), F.sum("pos_in_read").cast("long").alias("positions")]
    return _piled(spark, sf_dir).groupBy("chrom", "start", "bs_strand", "status").agg(*sums)


@query(f"""WITH {PILEUP}, w AS (SELECT *, count(*) OVER g AS n, min(status) OVER g AS lo, max(status) OVER g AS hi, row_number() OVER (PARTITION BY chrom, start, qname ORDER BY phred DESC, file_ord) AS k FROM piled WINDOW g AS (PARTITION BY chrom, start, qname))
 SELECT chrom, start, count(*) AS n, count(*) FILTER (WHERE n = 2 AND k = 2) AS overlapping, count(*) FILTER (WHERE NOT (n = 2 AND k = 2) AND status = 8) AS n_meth FROM w WHERE NOT (n = 2 AND lo <> hi) GROUP BY ALL""")
def pileup_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates that overlap at a position, told in the cells of the pileup's join."""
    meth = (~F.col("overlap") & (F.col("status") == C.METH)).cast("long")
    return filters.overlap(_piled(spark, sf_dir, mates=True)).groupBy("chrom", "start").agg(F.count("*").alias("n"), F.sum(F.col("overlap").cast("long")).alias("overlapping"), F.sum(meth).alias("n_meth"))


@query(f"WITH {PILEUP} SELECT chrom, start, status, count(*) AS n, count(*) FILTER (WHERE mapq >= {MIN_MAPQ} AND phred >= {MIN_PHRED}) AS fine FROM piled GROUP BY ALL")
def counters_of_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters from one pass over the pileup, joined by their keys."""
    keys = {c: F.col(c) for c in ("chrom", "start", "status")}
    fine = (F.col("mapq") >= MIN_MAPQ) & (F.col("phred") >= MIN_PHRED)
    every = {"all": counters.Counter(keys, {"n": F.lit(1)}), "fine": counters.Counter(keys, {"fine": F.lit(1)}, fine)}
    # both tables are read from these sums, a row per position and status, which are kept: else each would be counted in a pass of its own
    found = counters.told_apart(counters.count_once(_piled(spark, sf_dir), every).persist(), every)
    return found["all"].join(found["fine"], list(keys), "left").fillna(0, ["fine"])


@query(f"WITH {CLASSIC} SELECT pos, sum(n_meth)::BIGINT AS n_meth, sum(n_meth + n_unmeth)::BIGINT AS n_total FROM classic WHERE motif = 'CG' AND bs_strand IN ('c_bc', 'w_bc') AND flen >= 210 GROUP BY pos")
def plateau_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plateau.curve(plateau.cg_counts(mbias.classic(_stats(spark, sf_dir))), plateau.PlateauConfig())


#: A plateau for the queries that test strata against one, with the strip in which every position agrees.
_HEIGHT, _SLOPE, _STRIP = 0.6, 0.0005, 0.02
#: Shown p-values are counted in millionths, cut at a place that no short decimal has, where both engines agree.
_OFF = 0.3819660112501


def _tail(k: str, n: str, p: str) -> str:
    """The doubled smaller tail of a binomial count, term by term."""
    c = f"(SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - ({p})))) FROM (SELECT unnest(generate_series(0, {k})) AS i))"
    return f"CASE WHEN {k} >= {n} THEN 0 ELSE (SELECT 2 * CASE WHEN c > 0.5 THEN 1 - c ELSE c END FROM (SELECT {c} AS c)) END"


P_VALUES = f"""{CLASSIC}, cg AS (SELECT bs_strand, flen, pos, n_meth AS k, n_meth + n_unmeth AS n, {_HEIGHT} + {_SLOPE} * (pos - 1) AS m FROM classic WHERE motif = 'CG'),
 tails AS (SELECT *, {_tail("k", "n", f"m - {_STRIP}")} AS a, {_tail("k", "n", f"m + {_STRIP}")} AS b FROM cg),
 pv AS (SELECT bs_strand, flen, pos, CASE WHEN k / n BETWEEN m - {_STRIP} AND m + {_STRIP} THEN 1 ELSE greatest(a, b) END AS p FROM tails)"""


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plateau.stratum_p_values(plateau.cg_counts(mbias.classic(_stats(spark, sf_dir))), _HEIGHT, _SLOPE, 1, _STRIP)


@query(f"WITH {P_VALUES} SELECT bs_strand, flen, pos, floor(p * 1000000 + {_OFF})::BIGINT AS millionths FROM pv")
def plateau_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p_values(spark, sf_dir).select("bs_strand", "flen", "pos", F.floor(F.col("p") * 1_000_000 + _OFF).alias("millionths"))


@query(f"""WITH {P_VALUES}, d AS (SELECT s.bs_strand, s.flen, i, coalesce(p, 0) AS p, CASE WHEN s.flen BETWEEN 1 AND 100 THEN s.flen - 1 ELSE 100 END AS e
  FROM (SELECT DISTINCT bs_strand, flen FROM pv) s CROSS JOIN (SELECT unnest(range(0, 101)) AS i) LEFT JOIN pv ON pv.bs_strand = s.bs_strand AND pv.flen = s.flen AND pos = i + 1),
 r AS (SELECT *, min((p > 0.1)::INT) OVER (PARTITION BY bs_strand, flen ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 AND i <= 95 AS run FROM d),
 a AS (SELECT bs_strand, flen, max(p) FILTER (WHERE i = 0) < 1e-6 AS low, max(p) FILTER (WHERE i = e) < 1e-6 AS high, min(i) FILTER (WHERE run) AS first, max(i) FILTER (WHERE run AND i + 6 <= e + 1) AS last FROM r GROUP BY ALL)
 SELECT bs_strand, flen, CASE WHEN (low AND first IS NULL) OR (high AND last IS NULL) OR NOT low THEN 0 ELSE first END::BIGINT AS start,
  CASE WHEN (low AND first IS NULL) OR (high AND last IS NULL) THEN 0 WHEN high THEN last + 6 ELSE 101 END::BIGINT AS "end" FROM a""")
def plateau_cut_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plateau.cut_ends(_p_values(spark, sf_dir), 1, READ_LENGTH)


# the plateau's search: every position's range of heights by bisection, intervals of intercepts for each slope, a sweep over their ends
_CURVE = f"""{CLASSIC}, line AS (SELECT pos, sum(n_meth)::BIGINT AS k, sum(n_meth + n_unmeth)::BIGINT AS n FROM classic WHERE motif = 'CG' AND bs_strand IN ('c_bc', 'w_bc') AND flen >= 210 GROUP BY pos),
 curve AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) - 1 AS x, k, n, CASE WHEN n > 0 THEN k / n END AS beta FROM line)"""
#: The strip of these queries: the synthetic reads agree with no plateau more closely than within a fifth.
_WIDE, _TOP, _GRID = 0.2, 0.0006, 999


def _fine(k: str, n: str, p: str) -> str:
    """Whether a height is not rejected."""
    return f"coalesce(log10(nullif(greatest(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE {_tail(k, n, p)} END, 0), 0)) > -8, false)"


def _ranges(strip: float, depth: int = 1) -> str:
    return f"""{_CURVE}, side AS (SELECT x, k * {depth} AS k, n * {depth} AS n, beta, e, least(greatest((k * {depth} + 0.5) / (n * {depth} + 1), 1e-9), 1 - 1e-9) AS peak FROM curve, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(e)),
 halved AS (SELECT x, k, n, e, peak AS good, e AS bad, 0 AS i FROM side UNION ALL
  SELECT x, k, n, e, CASE WHEN f THEN mid ELSE good END, CASE WHEN f THEN bad ELSE mid END, i + 1 FROM (SELECT *, {_fine("k", "n", "mid")} AS f FROM (SELECT *, (good + bad) / 2 AS mid FROM halved WHERE i < 45))),
 whole AS (SELECT x, max(good) FILTER (WHERE e = 0) AS lo, max(good) FILTER (WHERE e = 1) AS hi FROM halved WHERE i = 45 GROUP BY x),
 ranges AS MATERIALIZED (SELECT x, CASE WHEN fits THEN least(lo, coalesce(beta - {strip}, lo)) ELSE beta - {strip} END AS low, CASE WHEN fits THEN greatest(hi, coalesce(beta + {strip}, hi)) ELSE beta + {strip} END AS high
  FROM (SELECT x, lo, hi, beta, {_fine("k", "n", "peak")} AS fits FROM whole JOIN side USING (x) WHERE e = 0))"""


def _best(strip: float, depth: int = 1) -> str:
    return f"""{_ranges(strip, depth)}, middle AS (SELECT median(beta) AS m, count(*) AS size FROM curve),
 each AS (SELECT j, greatest(CASE WHEN low <= 0 THEN 0 ELSE ceil((low - (j * ({_TOP}::DOUBLE / {_GRID}) * x + (m - 0.1))) / (0.2::DOUBLE / {_GRID})) END, 0)::BIGINT AS a,
  least(CASE WHEN high >= 1 THEN {_GRID + 1} ELSE floor((high - (j * ({_TOP}::DOUBLE / {_GRID}) * x + (m - 0.1))) / (0.2::DOUBLE / {_GRID})) + 1 END, {_GRID + 1})::BIGINT AS b
  FROM ranges, middle, (SELECT unnest(range({_GRID + 1})) AS j) WHERE low <= high AND low <= 1 AND high >= 0),
 moves AS (SELECT j, i, sum(d) AS d FROM (SELECT j, a AS i, 1 AS d FROM each WHERE a < b UNION ALL SELECT j, b, -1 FROM each WHERE a < b) GROUP BY j, i),
 sweep AS (SELECT j, i, sum(d) OVER (PARTITION BY j ORDER BY i) AS n FROM moves), best AS (SELECT * FROM sweep ORDER BY n DESC, i, j LIMIT 1)"""


_MODEL = f"""{_best(_WIDE)}, plain AS (SELECT m - 0.1 + i * (0.2::DOUBLE / {_GRID}) AS a, j * ({_TOP}::DOUBLE / {_GRID}) AS b FROM best, middle),
 model AS MATERIALIZED (SELECT coalesce((SELECT median(beta) FROM curve, plain WHERE abs(beta - (a + b * x)) < {_WIDE}), a) AS a, b FROM plain)"""


def _line(spark: SparkSession, sf_dir: str, depth: int = 1) -> DataFrame:
    line = plateau.curve(plateau.cg_counts(mbias.classic(_stats(spark, sf_dir))), plateau.PlateauConfig())
    return line.select("pos", *[(F.col(c) * depth).alias(c) for c in ("n_meth", "n_total")])


_CONFIG = plateau.PlateauConfig(always_accept=_WIDE)
_NARROW = plateau.PlateauConfig().always_accept
#: Every read of the curve counts so many times where its positions would otherwise admit any height.
_DEPTH = 20


@query(f"WITH RECURSIVE {_ranges(_NARROW, _DEPTH)} SELECT x, floor(low * 1000 + {_OFF})::BIGINT AS low, floor(high * 1000 + {_OFF})::BIGINT AS high FROM ranges WHERE low <= high")
def plateau_admitted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heights that each position of the curve does not reject, in thousandths: tails near one are rounded, so heights agree to about seven digits."""
    found = plateau.admitted(_line(spark, sf_dir, _DEPTH), _NARROW)
    return found.select("x", *[F.floor(F.col(c) * 1000 + _OFF).alias(c) for c in ("low", "high")])


@query(f"WITH RECURSIVE {_best(_NARROW, _DEPTH)} SELECT i AS intercept, j AS slope, n::BIGINT AS agreeing, size AS positions FROM best, middle")
def plateau_sloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the intercept and slope on their grids that most positions of the curve agree with."""
    _, i, j, n, size = plateau.best_line(_line(spark, sf_dir, _DEPTH), plateau.PlateauConfig())
    return spark.createDataFrame([(i, j, n, size)], "intercept long, slope long, agreeing long, positions long")


@query(f"""WITH {_CURVE}, h AS (SELECT unnest(range({plateau.HEIGHTS})) AS h), l AS (SELECT h, log10(greatest(CASE WHEN h IN (0, {plateau.HEIGHTS - 1}) THEN 0 ELSE {_tail("k", "n", f"(h / {plateau.HEIGHTS - 1}.0::DOUBLE)")} END, 0) + 1e-30) AS l FROM h, curve)
 SELECT h, count(*) FILTER (WHERE l < -4) AS bad, floor(sum(CASE WHEN l < -8 THEN 0 ELSE l END) + {_OFF})::BIGINT AS log_p FROM l GROUP BY h""")
def plateau_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every height of a plateau without slope: the positions that reject it, and the sum of the others' log p-values, without its fraction."""
    return plateau.height_sums(_line(spark, sf_dir)).select("h", "bad", F.floor(F.col("total") + _OFF).alias("log_p"))


@query(f"""WITH RECURSIVE {_MODEL}, cg AS MATERIALIZED (SELECT bs_strand, flen, pos, n_meth AS k, n_meth + n_unmeth AS n, a + b * (pos - lo) AS m FROM classic, model, (SELECT min(pos) AS lo FROM classic WHERE motif = 'CG') WHERE motif = 'CG'),
 tails AS (SELECT *, {_tail("k", "n", f"m - {_WIDE}")} AS a, {_tail("k", "n", f"m + {_WIDE}")} AS b FROM cg),
 pv AS MATERIALIZED (SELECT bs_strand, flen, pos, CASE WHEN k / n BETWEEN m - {_WIDE} AND m + {_WIDE} THEN 1 ELSE greatest(a, b) END AS p FROM tails), ends AS (SELECT min(pos) AS lo, max(pos) AS hi FROM pv),
 d AS (SELECT s.bs_strand, s.flen, i, hi - lo + 1 AS size, coalesce(p, 0) AS p, CASE WHEN s.flen > 0 AND s.flen < hi - lo + 1 THEN s.flen - 1 ELSE hi - lo END AS e
  FROM (SELECT DISTINCT bs_strand, flen FROM pv) s CROSS JOIN (SELECT lo, hi, unnest(range(0, hi - lo + 1)) AS i FROM ends) LEFT JOIN pv ON pv.bs_strand = s.bs_strand AND pv.flen = s.flen AND pos = i + lo),
 r AS (SELECT *, min((p > 0.1)::INT) OVER (PARTITION BY bs_strand, flen ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 AND i <= size - 6 AS run FROM d),
 t AS (SELECT bs_strand, flen, max(size) AS size, max(p) FILTER (WHERE i = 0) < 1e-6 AS low, max(p) FILTER (WHERE i = e) < 1e-6 AS high, min(i) FILTER (WHERE run) AS first, max(i) FILTER (WHERE run AND i + 6 <= e + 1) AS last FROM r GROUP BY bs_strand, flen),
 base AS (SELECT bs_strand, flen, CASE WHEN (low AND first IS NULL) OR (high AND last IS NULL) OR NOT low THEN 0 ELSE first END::BIGINT AS start,
  CASE WHEN (low AND first IS NULL) OR (high AND last IS NULL) THEN 0 WHEN high THEN last + 6 ELSE size END::BIGINT AS "end" FROM t), {_SMOOTHING}
 SELECT bs_strand, flen, CASE WHEN "end" - start < 30 THEN 0 ELSE start END AS start, CASE WHEN "end" - start < 30 THEN 0 ELSE "end" END AS "end" FROM smooth""")
def plateau_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting sites detected in the classic table, from the curve to the smoothed sites."""
    return plateau.detect(mbias.classic(_stats(spark, sf_dir)), _CONFIG)

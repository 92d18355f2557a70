"""Alignments joined to index positions.

Reads are cut into CIGAR blocks, never into bases. Blocks and positions meet by bins, about as wide as blocks are long, and
the residual range condition. Bins that hold very many blocks, as amplicons make them, are dealt to tiles by the reads'
names. Rows that no output can see (bad flags, missing data, no strand, unknown bases, gaps) are dropped before the join.

Rows of the join keep their bin and tile (CELL). Both follow from position and name, so mates at a position are in one cell, and later
steps that group by position and name take the cell along and need no shuffle of their own.

An index of few rows goes to the reads instead (INDEX_ROWS): these stay where they are or, where mates have to meet, are dealt once by wide bin
and name, whole. There a window over reads, not bases, tells which stretch of a read another one of its name may share (ALONE), so later
steps sort only such bases.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

BIN = 1000
#: Columns of a cell: bin, tile of the spans, tile of the points.
CELL = ("cell_bin", "cell_span", "cell_point")
#: From so many rows on a bin is dealt to tiles. At most HOT_BINS bins are, those with most rows, so their list is broadcast whatever
#: the input; of all rows beyond it no bin has more than one in HOT_BINS.
TILE_ROWS, HOT_BINS = 20_000, 100_000
#: Blocks from which the bins' width is told, and its bounds.
WIDTH_SAMPLE, LEAST_BIN, MOST_BIN = 10_000, 64, 10_000
#: An index of at most so many rows, counted, is broadcast, by bins of 2 ** INDEX_BITS positions.
INDEX_ROWS, INDEX_BITS = 250_000, 6
#: Whether no other read of its name can be at a base's position.
ALONE = "alone"
#: CIGAR operations that advance in the read, in the reference, and that align bases.
IN_READ, IN_REFERENCE, ALIGNED = "MIS=X", "MDN=X", "M=X"


def cigar_ops(cigar: Column) -> Column:
    """CIGAR text as an array of (op, len)."""
    lens, ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 1), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), 2)
    return F.zip_with(lens, ops, lambda n, o: F.struct(o.alias("op"), n.cast("int").alias("len")))


def advance(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda acc, x: acc + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0))


def clip(ops: Column, last: bool) -> Column:
    """Soft-clipped letters at one end, seen through hard clips."""
    inner = F.filter(ops, lambda x: x["op"] != "H")
    end = F.get(inner, F.size(inner) - 1) if last else F.get(inner, F.lit(0))
    return F.coalesce(F.when(end["op"] == "S", end["len"]), F.lit(0))


def blocks(ops: Column, kinds: str = ALIGNED) -> Column:
    """Blocks of aligned bases as (ref, query, len), offsets from the read's start."""
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<ref:int,query:int,len:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.array(F.struct(acc["r"].alias("ref"), acc["q"].alias("query"), x["len"].alias("len")))
        none = F.array().cast("array<struct<ref:int,query:int,len:int>>")
        return F.struct(
            (acc["r"] + F.when(F.instr(F.lit(IN_REFERENCE), x["op"]) > 0, x["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(F.instr(F.lit(IN_READ), x["op"]) > 0, x["len"]).otherwise(0)).alias("q"),
            F.concat(acc["out"], F.when(F.instr(F.lit(kinds), x["op"]) > 0, here).otherwise(none)).alias("out"),
        )

    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


LAYOUT = "struct<clip_start:int,clip_end:int,span:int,blocks:array<struct<ref:int,query:int,len:int>>>"
_LAYOUT = pa.struct([*((c, pa.int32()) for c in ("clip_start", "clip_end", "span")), ("blocks", pa.list_(pa.struct([(c, pa.int32()) for c in ("ref", "query", "len")])))])


def layout_of(cigar: str) -> dict:
    """Clips, length in the reference and aligned blocks of one CIGAR text, as ``clip``, ``advance`` and ``blocks`` have them."""
    ops = [(int(n), op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]
    inner = [(n, op) for n, op in ops if op != "H"]
    ends = [inner[i][0] if inner and inner[i][1] == "S" else 0 for i in (0, -1)]
    ref = query = 0
    found = []
    for n, op in ops:
        if op in ALIGNED:
            found.append({"ref": ref, "query": query, "len": n})
        ref += n * (op in IN_REFERENCE)
        query += n * (op in IN_READ)
    return {"clip_start": ends[0], "clip_end": ends[1], "span": ref, "blocks": found}


def layout(cigar: Column) -> Column:
    """``layout_of`` each CIGAR, in Arrow batches: few texts differ within one, and each is read once there."""

    @F.arrow_udf(LAYOUT)
    def run(texts: pa.Array) -> pa.Array:
        d = texts.dictionary_encode()
        return pa.array([layout_of(t) for t in d.dictionary.to_pylist()], _LAYOUT).take(d.indices)

    return run(cigar)


def read_level(alignments: DataFrame) -> DataFrame:
    """Usable reads with strand, clips, blocks and ``span``, their length in the reference; ``pos`` is 0-based, ``qual`` text with offset 33."""
    a = alignments.where(C.flags_ok(F.col("flag")) & C.info_ok(F.col("seq"), F.col("qual"), F.col("cigar")))
    a = a.withColumn("bs_strand", C.bs_strand(F.col("flag"))).where(F.col("bs_strand").isNotNull()).withColumn("_layout", layout(F.col("cigar")))
    return a.withColumns({
        **{c: F.col(f"_layout.{c}") for c in ("clip_start", "clip_end", "span", "blocks")},
        "qlen": F.length("seq"), "is_read1": F.col("flag").bitwiseAND(64) != 0,
    }).drop("_layout")


def hot_bins(rows: DataFrame, by: str, most: int) -> DataFrame | None:
    """The bins with more than ``most`` rows and the tiles that each is dealt to; None if there are none. One aggregate of two columns."""
    counted = rows.groupBy(by, CELL[0]).agg(F.count("*").alias("_c")).where(F.col("_c") > most)
    found = counted.orderBy(F.desc("_c")).limit(HOT_BINS).select(by, CELL[0], F.ceil(F.col("_c") / most).cast("int").alias("_tiles"))
    held = found.collect()
    return rows.sparkSession.createDataFrame(held, found.schema) if held else None


def interval_join(spans: DataFrame, points: DataFrame, start: str = "start", length: str = "len", point: str = "pos", by: str = "chrom", width: int = BIN, deal: str | None = None, most: int | None = TILE_ROWS, keep_cell: bool = False) -> DataFrame:
    """Pairs of a span and a point within [start, start + length) of the same ``by``. Bins are best about as wide as
    the spans are long: wider ones make pairs that do not meet, narrower ones copies of the spans (``span_width``).

    Bins with more than ``most`` spans or points are counted out and dealt: their spans go to one of several tiles by the hash of ``deal``
    (else of the whole span) and meet copies of the points there, and the points likewise, by their place (without ``deal`` by the whole row,
    as many rows may stand at one place). ``most`` = None leaves that out. With ``keep_cell``
    the rows have the columns of CELL."""
    s = spans.where(F.col(length) > 0)
    key = F.xxhash64(deal) if deal else F.xxhash64(*[F.col(f"`{c}`") for c in s.columns])
    s = s.withColumn(CELL[0], F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(start) + F.col(length) - 1) / width).cast("long"))))
    p = points.withColumn(CELL[0], F.floor(F.col(point) / width).cast("long"))
    at = [by, CELL[0]]
    hot = {} if most is None else {c: h for c, rows in ((CELL[1], s), (CELL[2], p)) if (h := hot_bins(rows, by, most)) is not None}

    def dealt(rows: DataFrame, own: str, value: Column) -> DataFrame:
        for c in (CELL[1], CELL[2]):
            if c not in hot:
                rows = rows.withColumn(c, F.lit(0))
                continue
            tiles = F.coalesce(F.col("_tiles"), F.lit(1))
            rows = rows.join(F.broadcast(hot[c]), at, "left")
            rows = rows.withColumn(c, F.pmod(value, tiles.cast("long")).cast("int") if c == own else F.explode(F.sequence(F.lit(0), tiles - 1))).drop("_tiles")
        return rows

    pairs = dealt(s, CELL[1], key).join(dealt(p, CELL[2], F.xxhash64(F.col(point)) if deal else F.xxhash64(*[F.col(f"`{c}`") for c in points.columns])), [by, *CELL] if hot else at)
    if not hot:
        pairs = pairs.select(by, *[F.col(c) for c in pairs.columns if c not in (by, *CELL)], CELL[0], F.lit(0).alias(CELL[1]), F.lit(0).alias(CELL[2]))
    pairs = pairs.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length)))
    return pairs if keep_cell else pairs.drop(*CELL)


def span_width(spans: DataFrame, length: str = "len") -> int:
    """The counted mean length of the spans, 1 at least: one aggregate over one column."""
    return max(1, round(spans.where(F.col(length) > 0).agg(F.coalesce(F.avg(length), F.lit(1))).first()[0]))


def with_mates(reads: DataFrame, width: int = MOST_BIN) -> DataFrame:
    """Whole reads dealt by name and wide bin, a copy in every bin they reach into: from ``_lo`` back and from ``_hi`` on a read of its name may share
    a position with it, ``_shared`` if that is within the read."""
    end = F.col("pos") + F.col("span")
    # no filter by the layout: it would be moved to the reads, where each CIGAR were read once more
    r = reads.withColumn(CELL[0], F.explode(F.sequence(F.floor(F.col("pos") / width).cast("long"), F.floor(F.greatest(end - 1, F.col("pos")) / width).cast("long"))))
    w = Window.partitionBy("rname", CELL[0], "qname").orderBy("pos")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumns({"_lo": F.coalesce(before, F.col("pos")), "_hi": F.coalesce(F.lead("pos").over(w), end)})
    return r.withColumn("_shared", (F.col("_lo") > F.col("pos")) | (F.col("_hi") < end))


def pileup_reads(alignments: DataFrame, index: DataFrame, width: int | None = None, most: int | None = TILE_ROWS, mates: bool = True) -> DataFrame:
    """One row per index position and read aligned there with a usable base, with the cell it was found in. Positions without reads are
    not among them: aggregates join the index back (``calls``), which is far smaller than outer-joined reads.

    Unless a ``width`` of bins is given, an index of at most INDEX_ROWS rows is broadcast. Then rows have ALONE, and without ``mates`` neither that nor
    a cell: the reads are not shuffled at all. Else the bins' width is told from the first blocks; it has no part in the result. Deep bins are
    counted in a pass of their own over the reads' places (``most`` = None leaves it out)."""
    w = F.when(F.col("strand") == "+", "C").otherwise("G")
    points = index.withColumn("watson_base", w).withColumnRenamed("start", "_p")
    few = width is None and index.limit(INDEX_ROWS + 1).count() <= INDEX_ROWS
    r = read_level(alignments)
    if few and mates:
        r = with_mates(r)
    # all that can be told of a read is told there: a position in it is _from + _step * its place in the letters
    reverse, letters = F.col("bs_strand").isin("c_bc", "w_bc_rv"), ("_kept", "_lost", "_other")
    r = r.withColumns({
        **dict(zip(letters, C.strand_letters(F.col("bs_strand")), strict=True)), "seq": F.upper("seq"), "_flen": F.abs("tlen"), "_step": F.when(reverse, -1).otherwise(1),
        "_from": C.pos_in_read(F.col("bs_strand"), F.lit(0), F.col("qlen"), F.col("clip_start"), F.col("clip_end")),
    })
    r = r.select("*", F.explode_outer("blocks").alias("b")).where("b IS NOT NULL").withColumns({"_b": F.col("pos") + F.col("b.ref"), "_n": F.col("b.len"), "_q": F.col("b.query")})
    r = r.withColumns({"_last": F.col("_b") + F.col("_n"), "_back": F.col("_q") - F.col("_b")})
    r = r.withColumnRenamed("rname", "chrom").drop("blocks", "b", "pos", "span", "cigar", "qlen", "clip_start", "clip_end", "_q")
    if few:
        spans = r.where("_n > 0").withColumn("_bin", F.explode(F.sequence(F.shiftright("_b", INDEX_BITS), F.shiftright(F.col("_last") - 1, INDEX_BITS))))
        p = spans.join(F.broadcast(points.withColumn("_bin", F.shiftright("_p", INDEX_BITS))), ["chrom", "_bin"])
        p = p.where((F.col("_p") >= F.col("_b")) & (F.col("_p") < F.col("_last")))
        if mates:
            p = p.where(F.floor(F.col("_p") / MOST_BIN) == F.col(CELL[0]))
            p = p.withColumn(ALONE, ~(F.col("_shared") & ((F.col("_p") < F.col("_lo")) | (F.col("_p") >= F.col("_hi")))))
    else:
        if width is None:
            width = min(MOST_BIN, max(LEAST_BIN, span_width(r.select("_n").limit(WIDTH_SAMPLE), "_n")))
        p = interval_join(r, points, "_b", "_n", "_p", width=width, deal="qname", most=most, keep_cell=True)
    p = p.withColumn("qpos", (F.col("_p") + F.col("_back")).cast("int")).withColumns({
        "start": F.col("_p"), "base": F.substring("seq", F.col("qpos") + 1, F.lit(1)), "phred": F.ascii(F.substring("qual", F.col("qpos") + 1, F.lit(1))) - 33,
        "pos_in_read": F.col("_from") + F.col("_step") * F.col("qpos"),
    })
    # a known base of a read with a strand has a status; said by the base, as the filter is moved below the status and would make it twice
    p = p.where((F.col("base") != "N") & (F.col("pos_in_read") < F.col("_flen")))
    p = p.withColumn("status", C.meth_status(F.col("base"), F.col("watson_base"), F.col("bs_strand"), tuple(map(F.col, letters))))
    extra = [c for c in ("seq_context", "triplet_seq") if c in index.columns]
    own = [c for c in (*CELL, ALONE) if c in p.columns]
    return p.select("chrom", "start", "end", "motif", "strand", *extra, F.col("qname").alias("read_name"), "file_ord", "bs_strand", "is_read1", "mapq", F.col("tlen").cast("long").alias("tlen"), "base", "phred", "pos_in_read", "status", *own)

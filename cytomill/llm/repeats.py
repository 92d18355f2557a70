"""Substring deduplication by seeds and extensions over words.

Seeds are winnowed anchors: of the hashes of all ANCHOR-word runs, those that are smallest in some
window of ``length`` words (of equals, the last). Every window has one anchor, equal windows have it at
the same place, and the windows of an anchor are consecutive: its block. Documents that share a
passage of ``length`` words meet in a join on anchors; anchors that occur once end there.

Around the others the match is extended both ways. Occurrences whose whole blocks agree are repeated as
far as the block reaches, and one of them stands for all. Blocks that agree with no other are extended
window by window against one of each kind with their anchor. All occurrences are compared at once by
hashes, never pair by pair, so a passage of a third of all documents costs what its occurrences cost.
Adjacent repeated windows join to maximal repeats.

Words, anchors, blocks and windows are compared by 64-bit hashes; what is compared agrees in its anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import store
from .words import U, _powers, bounds, buffer_of, hashes, mix, pieces

LENGTH, ANCHOR = 35, 8
BASE = 0x5851F42D4C957F2D


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling; as many values as there are runs."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    return pick(x[:n], x[width - span : width - span + n])


PLACE = U((1 << 26) - 1)  # of a run's hash, the low bits give way to its place


class Runs:
    """Word runs of a batch of texts."""

    def __init__(self, col: pa.Array, length: int) -> None:
        self.length = length
        self.data, self.offs = buffer_of(col)
        self.starts, self.ends, self.first = bounds(self.data, self.offs)
        self.words = hashes(self.data, self.starts, self.ends)
        n = len(self.words)
        self.size = 1 << max(10, n.bit_length())
        self.sums = np.zeros(n + 1, U)
        np.cumsum(self.words * _powers(BASE, self.size)[:n], out=self.sums[1:])

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences from ``begin`` to ``end``, their lengths included."""
        return mix((self.sums[end] - self.sums[begin]) * _powers(pow(BASE, -1, 1 << 64), self.size)[begin] + (end - begin).astype(U))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors' hashes, and for each the first of its windows and their number."""
        n, steps = len(self.words), self.length - ANCHOR + 1
        if n < self.length:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        odd = [U(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(ANCHOR)]
        runs = self.words[: n - ANCHOR + 1] * odd[0]
        for i in range(1, ANCHOR):
            runs += self.words[i : n - ANCHOR + 1 + i] * odd[i]
        runs = mix(runs)
        windows = n - self.length + 1
        least = sliding((runs & ~PLACE) | (PLACE - (np.arange(len(runs)).astype(U) & PLACE)), steps, np.minimum)
        back = (PLACE - (least & PLACE)).astype(np.int64)
        place = back + ((np.arange(windows) + steps - 1 - back) >> 26 << 26)  # a text of more than 2**26 words
        inside = np.arange(windows) + self.length <= np.repeat(self.first[1:], np.diff(self.first))[:windows]
        at = np.flatnonzero(inside)
        if not len(at):
            return np.zeros(0, U), at, at
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        return runs[place[at[head]]], at[head], np.diff(np.append(head, len(at)))


BLOCK_ROWS = "anchor long, block long, row_key long, start int, n int"


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            r = Runs(batch.column(1), length)
            anchor, start, n = r.blocks()
            row = np.searchsorted(r.first, start, side="right") - 1
            block = r.hashed(start, start + n + length - 1)
            cols = [anchor.view(np.int64), block.view(np.int64), batch.column(0).to_numpy()[row], (start - r.first[row]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "block", "row_key", "start", "n"])

    return run


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column; null is empty."""
    col = col.cast(pa.large_list(pa.int64()))
    if col.null_count:
        col = col.fill_null([])
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64), offs - offs[0]


def _ranges(places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and offsets by row of a column of lists start * 2**20 + number; null is empty."""
    values, offs = _lists(places)
    return values >> 20, values & ((1 << 20) - 1), offs


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            r = Runs(batch.column(1), length)
            start, n, offs = _ranges(batch.column(2))
            row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(offs)), n)
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window = r.hashed(at + r.first[row], at + r.first[row] + length)
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(at.astype(np.int32))], names=["window", "row_key", "start"])

    return run


def _drop(length: int, text: int, starts: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, batches_text):
            data, offs = buffer_of(batch.column(text))
            begin, end, first = bounds(data, offs)
            at, n, cut = _ranges(batch.column(starts))
            at = at + np.repeat(first[:-1], np.diff(cut))
            depth = np.zeros(len(begin) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + n + length - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[first[1:]] - total[first[:-1]]
            # kept words with one space after each, as slices of one buffer
            b, e = begin[~gone], end[~gone]
            size = e - b + 1
            out_at = np.concatenate([[0], np.cumsum(size)])
            src = np.repeat(b - out_at[:-1], size) + np.arange(out_at[-1])
            joined = np.append(data, np.uint8(32))[np.minimum(src, len(data))]
            joined[out_at[1:] - 1] = 32
            kept_first = first - total[first]
            lo, hi = out_at[kept_first[:-1]], out_at[kept_first[1:]]
            raw = joined.tobytes()
            texts = [raw[i : max(i, j - 1)].decode() for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            # maximal repeats as word ranges
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(gone))]
            inner = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
            ups = np.sort(np.concatenate([np.flatnonzero(edge[:-1] > 0), inner]))
            downs = np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
            owner = np.searchsorted(first, ups, side="right") - 1
            span_at = np.searchsorted(owner, np.arange(len(first)))
            flat = np.stack([ups - first[owner], downs - first[owner]], 1).astype(np.int32).ravel()
            spans = pa.ListArray.from_arrays(pa.array((2 * span_at).astype(np.int32)), pa.array(flat))
            cols = [*(batch.column(i) for i in keep), pa.array(np.diff(first)), pa.array(removed), pa.array(texts, pa.string()), spans]
            yield pa.RecordBatch.from_arrays(cols, names=[*(batch.schema.names[i] for i in keep), "n_words", "n_removed", "kept_text", "repeats"])

    batches_text = "_text"
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (long), ``kept_text`` (the words outside repeats, joined by
    one space) and ``repeats`` (int array: begin and end of each maximal repeat, in words).

    A word goes if a window of ``length`` consecutive words covers it whose sequence also starts
    anywhere else, in the same or another row; all copies go. Repeated rows are copies of each other
    even if they share a key. A null text has no words and a null in ``kept_text`` is never returned.
    Texts of fewer than ``length`` words stay whole. Columns with the names above are replaced; others may have any name.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    spark = docs.sparkSession
    store.bound_batches(spark)
    tables = store.Tables(spark)
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "repeats")]
    body = F.coalesce(F.col(text), F.lit(""))
    row_key = F.xxhash64(F.col(key), F.col(text))
    slim = docs.select(row_key.alias("row_key"), body.alias("text"))
    anchors = tables.cut(slim.mapInArrow(_anchors(length), BLOCK_ROWS), "anchors")
    twice = tables.cut(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "twice")
    met = tables.cut(store.with_value(anchors, twice, ["anchor"], "c", anchors.count(), whole=False).drop("c"), "met")
    tables.drop("anchors", "twice")
    store.forget_shuffles(spark)
    place = F.shiftleft(F.col("start").cast("long"), 20) + F.col("n")
    kinds = tables.cut(met.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.min(F.struct("row_key", place.alias("place"))).alias("one")), "kinds")
    open_ = kinds.where("c = 1").select("anchor").distinct()
    alone = kinds.join(open_, "anchor", "left_semi").groupBy("one.row_key").agg(F.collect_set("one.place").alias("places"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grown = slim.join(alone, "row_key").select("row_key", "text", "places")
    windows = tables.cut(grown.mapInArrow(_extend(length), "window long, row_key long, start int"), "windows")
    again = tables.cut(windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1"), "again")
    single = store.with_value(windows, again, ["window"], "c", windows.count(), whole=False).select("row_key", (F.shiftleft(F.col("start").cast("long"), 20) + 1).alias("place"))
    same = kinds.where("c > 1").select("anchor", "block", "c")
    whole = store.with_value(met, same, ["anchor", "block"], "c", met.count(), whole=False).select("row_key", place.alias("place"))
    starts = tables.cut(whole.union(single).groupBy(F.col("row_key").alias("_k")).agg(F.collect_set("place").alias("_starts")), "starts")
    tables.drop_all_but("starts")
    store.forget_shuffles(spark)
    # the caller's columns travel in one, so that none of their names can clash
    aside = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    dealt = docs.select(row_key.alias("_row_key"), body.alias("_text"), aside.alias("_own")).repartition(parts, "_row_key")
    full = dealt.join(starts, dealt["_row_key"] == starts["_k"], "left").select("_own", "_text", "_starts")
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("repeats", ArrayType(IntegerType()))]
    out = full.mapInArrow(_drop(length, 1, 2, [0]), StructType([full.schema["_own"], *added]))
    return out.select(*[F.col("_own")[c].alias(c) for c in own], *[f.name for f in added])

"""Suffix-array deduplication: byte strings of a fixed length that came before are removed.

All suffixes of a corpus cannot be sorted in one place, and need not be: only those that share a long string have to
meet. Of the hashes of all ANCHOR-byte strings, those that are smallest in some window of ``length`` bytes (of equals, the last)
are anchors. Every window has one anchor, equal windows have it at the same place, and the windows of an anchor are
consecutive: its block. Blocks that agree byte for byte are one kind, all of whose windows start first in its first block.

The first blocks of all kinds of an anchor come to one task, which sorts their suffixes: prefix polynomial hashes give the
hash of any substring in constant time, a binary search over its length gives the common extension of two suffixes, and
the byte behind it their order, so a comparison takes a logarithmic number of steps. Suffixes at the same distance from their anchor
are merge-sorted, all groups at once in numpy; the sort is stable, so of suffixes that agree over ``length`` bytes the first is
that of the smallest document. Neighbours of the sorted order are then held against the bytes themselves: if a hash has
collided anywhere, the order is made again from the bytes.

Anchors with more than HOT_KINDS kinds (a phrase that many documents put among other words) do not come to one task: their
windows are rows of their own, dealt and reduced by 64 bits of hash beside the anchor's 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import store
from .repeats import _lists, sliding
from .words import U, _powers, _tables, buffer_of, mix, pieces, spans

LENGTH, ANCHOR = 100, 32
#: First blocks of an anchor that one task sorts at most.
HOT_KINDS = 4096
#: Windows of a text that are worked on together, and suffixes that are sorted together.
STRETCH, SORTED = 1 << 21, 1 << 20
LOW = U((1 << 32) - 1)  # of an anchor's hash, the low bits give way to its place
SEED = 11


class Prefixes:
    """Prefix polynomial hashes of a buffer: the hash of any substring from two of them."""

    def __init__(self, data: np.ndarray) -> None:
        table, base, inverse = _tables(SEED)
        n = len(data)
        size = 1 << max(16, n.bit_length())
        self.sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * _powers(base, size)[:n], out=self.sums[1:])
        self.back = _powers(inverse, size)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def blocks(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, content, row, place of every block of a batch, by stretches. The place holds the first window's start in its text, the
    anchor's distance from it and the number of windows: start * 2**20 + lead * 2**10 + n. A block on the border of two stretches
    of a long text comes in two parts, which are kinds of their own."""
    ends, steps = np.repeat(offs[1:], np.diff(offs)), length - ANCHOR + 1
    for c in range(0, len(data) - length + 1, STRETCH):
        d = data[c : c + STRETCH + length - 1]
        p = Prefixes(d)
        at = np.arange(len(d) - ANCHOR + 1)
        runs = mix(p.of(at, at + ANCHOR))
        least = sliding((runs & ~LOW) | (LOW - at.astype(U)), steps, np.minimum)
        place = (LOW - (least & LOW)).astype(np.int64)
        start = np.flatnonzero(np.arange(c, c + len(place)) + length <= ends[c : c + len(place)])
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (place[start[1:]] != place[start[:-1]]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(start)))
        first, anchor = start[head], place[start[head]]
        row = np.searchsorted(offs, first + c, side="right") - 1
        yield runs[anchor], mix(p.of(first, first + n + length - 1)), row, ((first + c - offs[row]) << 20) + ((anchor - first) << 10) + n


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for anchor, content, row, place in blocks(*buffer_of(batch.column(2)), length):
                rows = pa.array(row)
                cols = [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "content", "key", "h", "place"])

    return run


def _bytes_of(length: int):
    """The bytes of the blocks listed beside a text; rows alike in key and text give theirs once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            _, once = np.unique(batch.column(2).to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            data, offs = buffer_of(batch.column(3))
            anchor, cut = _lists(batch.column(4))
            place, _ = _lists(batch.column(5))
            kinds, _ = _lists(batch.column(6))
            row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            start = offs[row] + (place >> 20)
            size = (place & 1023) + length - 1
            for i in range(0, len(row), 1 << 16):
                k = slice(i, i + (1 << 16))
                stop = np.cumsum(size[k])
                flat = data[np.repeat(start[k] - (stop - size[k]), size[k]) + np.arange(stop[-1])]
                raw = spans(flat, np.concatenate([[0], stop])).cast(pa.binary())
                rows = pa.array(row[k])
                cols = [pa.array(anchor[k]), batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(place[k]), pa.array(kinds[k]), raw]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "key", "h", "id", "place", "kinds", "raw"])

    return run


def common(p: Prefixes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The common extensions of suffixes ``a`` and ``b``, up to ``length``, by a binary search over hashes of equal lengths."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    for _ in range(length.bit_length()):
        mid = (low + high + 1) >> 1
        same = p.of(a, a + mid) == p.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def merge_sort(data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the suffixes ``at`` within groups of ``size`` consecutive ones by their first ``length`` bytes, stably, and
    which of them, sorted, agree with the one before over all of these. Runs of all groups are merged at once: a suffix's
    new place is its own in its run and the number of those in the neighbouring run that come before it."""
    p = Prefixes(data)
    first = np.repeat(np.cumsum(size) - size, size)
    own, many = np.arange(len(at)) - first, np.repeat(size, size)
    order = np.arange(len(at))

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        same = common(p, a, b, length)
        end = same == length
        same = np.minimum(same, length - 1)
        return np.where(end, or_equal, data[a + same] < data[b + same])

    k = 0
    while (active := np.flatnonzero(many > 1 << k)).size:
        base, j, n = first[active], own[active], many[active]
        run, me = j >> k, at[order[active]]
        sibling = base + ((run ^ 1) << k)
        low, high = np.zeros(len(active), np.int64), np.clip(n - ((run ^ 1) << k), 0, 1 << k)
        for _ in range(k + 1):  # of equal suffixes those of the left run come first
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            less = before(at[order[sibling[open_] + mid]], me[open_], (run[open_] & 1) == 1)
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        moved = order.copy()
        moved[base + ((run >> 1) << (k + 1)) + (j & ((1 << k) - 1)) + low] = order[active]
        order = moved
        k += 1
    equal = np.zeros(len(at), bool)
    pair = np.flatnonzero(own > 0)
    equal[pair] = verified(data, p, at[order[pair - 1]], at[order[pair]], length)
    return order, equal


class Collision(Exception):
    """Two strings with the same hash are not the same."""


def verified(data: np.ndarray, p: Prefixes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which neighbours agree over ``length`` bytes. Their bytes are compared, not their hashes: neighbours that are in order one by one are in order as a
    whole, so a collision anywhere in the sort shows here, and raises."""
    equal, steps = np.empty(len(a), bool), np.arange(length)
    for i in range(0, len(a), 1 << 15):
        k = slice(i, i + (1 << 15))
        x, y = data[a[k, None] + steps], data[b[k, None] + steps]
        differ = x != y
        equal[k] = ~differ.any(1)
        at = differ.argmax(1)
        rows = np.arange(len(x))
        if not (equal[k] | (x[rows, at] < y[rows, at])).all():
            raise Collision
    return equal


def plain_sort(data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the bytes alone."""
    raw, group = data.tobytes(), np.repeat(np.arange(len(size)), size)
    keys = [(g, raw[i : i + length]) for g, i in zip(group.tolist(), at.tolist(), strict=True)]
    order = sorted(range(len(at)), key=keys.__getitem__)
    return np.array(order, np.int64), np.array([i > 0 and keys[order[i]] == keys[order[i - 1]] for i in range(len(order))], bool)


def later(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and window numbers of all windows in blocks of whole anchors, in the order of documents, that agree with an earlier one."""
    data, offs = buffer_of(batch.column("raw").cast(pa.large_binary()))
    place, anchor = batch.column("place").to_numpy(), batch.column("anchor").to_numpy()
    group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
    n, lead = place & 1023, (place >> 10) & 1023
    rows, found = [], []
    ends = np.cumsum(n)
    i = 0
    while i < len(n):  # whole anchors, about SORTED windows
        j = int(np.searchsorted(ends, ends[i] - n[i] + SORTED, side="right"))
        j = len(n) if j >= len(n) else max(int(np.searchsorted(group, group[max(j, i)])), int(np.searchsorted(group, group[i], side="right")))
        row = np.repeat(np.arange(i, j), n[i:j])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        cell = group[row] * 1024 + lead[row] - nth  # equal windows have their anchor at the same distance
        by = np.argsort(cell, kind="stable")
        _, size = np.unique(cell[by], return_counts=True)
        by, size = by[np.repeat(size, size) > 1], size[size > 1]
        at = offs[row[by]] + nth[by]
        try:
            order, equal = merge_sort(data, at, size, length)
        except Collision:
            order, equal = plain_sort(data, at, size, length)
        hit = by[order[equal]]
        rows.append(row[hit])
        found.append(nth[hit])
        i = j
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (none, none)


def _stretches(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Key, text hash and place of the stretches of windows that go."""
    row, nth = later(batch, length)
    by = np.lexsort((nth, row))
    row, nth = row[by], nth[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(row)))
    rows = pa.array(row[head])
    place = (((batch.column("place").to_numpy()[row[head]] >> 20) + nth[head]) << 20) + n
    return pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("h").take(rows), pa.array(place)], names=["key", "h", "place"])


def _sorted(length: int):
    """Rows come by anchor, and of an anchor by document. Batches are cut where an anchor ends."""

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        (t,) = pa.Table.from_batches(parts).combine_chunks().to_batches()
        a, i, p = (t.column(c).to_numpy() for c in ("anchor", "id", "place"))
        again = np.zeros(len(i), bool)
        again[1:] = (i[1:] == i[:-1]) & (p[1:] == p[:-1]) & (a[1:] == a[:-1])  # repeated rows
        return _stretches(t.filter(pa.array(~again)), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))[-1])  # the last anchor may go on
            if held and a[0] != held[-1].column(0)[-1].as_py() and size > 4 << 20:
                yield work(held)
                held, size = [], 0
            if cut and size + batch.nbytes > 4 << 20:
                yield work([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield work(held)

    return run


def _windows(length: int):
    """Every window of blocks as a row: anchor, distance, hash, key, text hash, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffer_of(batch.column("raw").cast(pa.large_binary()))
            place = batch.column("place").to_numpy()
            n = place & 1023
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = offs[row] + nth
            window = mix(Prefixes(data).of(at, at + length))
            rows = pa.array(row)
            cols = [batch.column(0).take(rows), pa.array((((place >> 10) & 1023)[row] - nth).astype(np.int32)), pa.array(window.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows), pa.array((((place >> 20)[row] + nth) << 20) + 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "lead", "window", "key", "h", "place"])

    return run


def _drop(length: int, text: int, places: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, offs = buffer_of(batch.column(text))
            place, cut = _lists(batch.column(places))
            at = (place >> 20) + np.repeat(offs[:-1], np.diff(cut))
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + (place & 1023) + length - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(gone))]
            inner = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner  # runs end with their text
            ups, downs = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner])), np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
            owner = np.searchsorted(offs, ups, side="right") - 1
            first = np.searchsorted(owner, np.arange(len(offs)))
            flat = np.stack([ups - offs[owner], downs - offs[owner]], 1).ravel()
            listed = pa.ListArray.from_arrays(pa.array((2 * first).astype(np.int32)), pa.array(flat))
            kept = spans(data[~gone], offs - total[offs]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(np.diff(offs)), pa.array(np.diff(total[offs])), pa.array(np.diff(first)), kept, listed], names=["_own", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


ADDED = ("n_bytes", "n_removed", "n_spans", "kept", "spans")


def remove_earlier(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (long), ``kept`` (binary, the remaining bytes of the text in UTF-8) and
    ``spans`` (long array: begin and end of each maximal removed run).

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller key, or
    before it in the same document. Strings are judged on the input. Texts of fewer bytes stay whole; a null or empty text has no bytes.
    Rows without a key come after all others; rows that share a key but not the text are ordered by a hash of the
    text; rows alike in both are one document, and each gets its result. Matches never cross documents. Removed runs may
    end inside a letter, so what is kept is bytes. Columns named as those added are replaced; others may have any name. An
    empty table gives no rows.
    """
    if length < ANCHOR or length > 1000:
        raise ValueError(f"length must be from {ANCHOR} to 1000")
    spark = docs.sparkSession
    store.bound_batches(spark)
    tables = store.Tables(spark)
    own = [c for c in docs.columns if c not in ADDED]
    body = F.coalesce(F.col(text), F.lit(""))
    hashed, kind = F.xxhash64(body), docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), hashed.alias("h"), body.alias("text"))

    def order(at: str = "") -> Column:
        return F.struct(F.col(f"{at}key").isNull().alias("none"), F.col(f"{at}key").alias("key"), F.col(f"{at}h").alias("h"), F.col(f"{at}place").alias("place"))

    with store.shuffles_end_with_jobs(spark):
        found = tables.cut(slim.mapInArrow(_blocks(length), f"anchor long, content long, key {kind}, h long, place long"), "blocks")
        twice = tables.cut(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "twice")
        met = tables.cut(store.with_value(found, twice, ["anchor"], "c", found.count(), whole=False).drop("c"), "met")
        tables.drop("blocks", "twice")
        kinds = tables.cut(met.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(order()).alias("one")), "kinds")
        copied = kinds.where("c > 1").select("anchor", "content", "c", "one")
        whole = store.with_value(met, copied, ["anchor", "content"], "c", met.count(), whole=False).where(order() > F.col("one")).select("key", "h", "place")
        gone = [tables.cut(whole, "whole")]
        tables.drop("met")
        several = tables.cut(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
        firsts = store.with_value(kinds.select("anchor", "one"), several, ["anchor"], "kinds", kinds.count(), whole=False)
        listed = firsts.groupBy(F.col("one.key").alias("_key"), F.col("one.h").alias("_h")).agg(F.collect_list(F.struct("anchor", "one.place", "kinds")).alias("b"))
        near = slim.join(listed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")))
        asked = near.select("key", "h", F.xxhash64("key", "h").alias("id"), "text", *[F.col(f"b.{c}").alias(c) for c in ("anchor", "place", "kinds")])
        raw = tables.cut(asked.mapInArrow(_bytes_of(length), f"anchor long, key {kind}, h long, id long, place long, kinds long, raw binary"), "raw")
        tables.drop("kinds")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        few = raw.where(F.col("kinds") <= HOT_KINDS).repartition(parts, "anchor").sortWithinPartitions("anchor", F.col("key").isNull(), "key", "h", "place")
        gone.append(tables.cut(few.mapInArrow(_sorted(length), f"key {kind}, h long, place long"), "sorted"))
        if several.where(F.col("kinds") > HOT_KINDS).limit(1).count():
            rows = raw.where(F.col("kinds") > HOT_KINDS).mapInArrow(_windows(length), f"anchor long, lead int, window long, key {kind}, h long, place long")
            windows, at = tables.cut(rows, "windows"), ["anchor", "lead", "window"]
            least = tables.cut(windows.groupBy(*at).agg(F.count("*").alias("c"), F.min(order()).alias("one")).where("c > 1"), "least")
            gone.append(tables.cut(store.with_value(windows, least, at, "c", windows.count(), whole=False).where(order() > F.col("one")).select("key", "h", "place"), "hot"))
        tables.drop("raw", "several", "windows", "least")
        every = gone[0]
        for g in gone[1:]:
            every = every.union(g)
        places = store.cut(every.groupBy(F.col("key").alias("_key"), F.col("h").alias("_h")).agg(F.collect_set(F.col("place").bitwiseAND(~(1023 << 10))).alias("_places")), "places")
        tables.drop_all_but()
    # the caller's columns travel in one, so that none of their names can clash
    aside = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    dealt = docs.select(F.col(key).alias("_k"), hashed.alias("_t"), body.alias("_text"), aside.alias("_own"))
    full = dealt.join(places, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_h")), "left").select("_own", "_text", "_places")
    added = [*(StructField(c, LongType()) for c in ADDED[:3]), StructField("kept", BinaryType()), StructField("spans", ArrayType(LongType()))]
    out = full.mapInArrow(_drop(length, 1, 2, 0), StructType([full.schema["_own"], *added]))
    return out.select(*[F.col("_own")[c].alias(c) for c in own], *ADDED)

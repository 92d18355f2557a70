"""Periodic runs of words by bit-parallel lags.

The words of a text are numbered by identity, and bit j of all numbers makes plane j: one big integer with a bit for each word.
A plane XORed with itself shifted by q has a bit wherever the words q apart differ in it; the OR over the planes has a zero
wherever they are the same word. ANDs of the zeros with themselves, shifted by 1, 2, 4 and so on, leave the places from which enough zeros
follow. Each such stretch, with q words more, is a run of period q, unless a smaller lag gave the same stretch.

A lag ends at the first plane after which no stretch is long enough, which for most lags is the first or second.
Before that, words that no run can hold are set aside: every word of a run lies in SEED words that stand elsewhere in it as well, so
only stretches of words in repeated SEED-word strings are searched, each with the lags up to half its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import store
from .words import U, bounds, buffer_of, hashes, mix, pieces, shingles

#: A run has LEAST words at least and two periods. So words q apart agree max(LEAST - q, q) times, SEED times at least.
LEAST = 12
SEED = LEAST // 2


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes of non-negative numbers, lowest first; bit i of a plane belongs to number i."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> j) & 1, bitorder="little").tobytes(), "little") for j in range(width)]


def stretches(bits: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of all maximal stretches of at least ``least`` ones."""
    long, done = bits, 1
    while long and done * 2 <= least:
        long &= long >> done
        done *= 2
    long &= long >> (least - done)
    base = 0
    while long:  # bits from which ``least`` ones follow
        skip = (long & -long).bit_length() - 1
        long >>= skip
        size = (~long & (long + 1)).bit_length() - 1
        yield base + skip, size + least - 1
        long >>= size
        base += skip + size


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among the words ``ids``, by start, then period. Quadratic in their number, by 64 words an operation."""
    n, found = len(ids), {}
    bit = planes(ids)
    for q in range(1, n // 2 + 1):
        least = max(LEAST - q, q)
        if n - q < least:
            continue
        same = (1 << (n - q)) - 1
        for j, p in enumerate(bit):
            same &= ~(p ^ (p >> q))
            if j and not any(True for _ in stretches(same, least)):
                break
        else:
            for start, size in stretches(same, least):
                found.setdefault((start, size + q), q)
            if (0, n) in found:  # all words: a run of a larger period would have the smaller one too
                break
    return sorted((start, length, q) for (start, length), q in found.items())


def candidates(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a SEED-word string that its text has twice or more, by hashes: an equal hash of other words only adds some."""
    out = np.zeros(len(h) + 1, np.int64)
    seed, at = shingles(h, first, SEED)
    row = np.repeat(np.arange(len(first) - 1), np.diff(at))
    with np.errstate(over="ignore"):
        seed = mix(seed ^ mix(row.astype(U) + U(1)))
    by = np.argsort(seed, kind="stable")
    equal = seed[by][1:] == seed[by][:-1]
    twice = np.zeros(len(seed), bool)
    twice[by[1:][equal]] = True
    twice[by[:-1][equal]] = True
    place = first[row] + np.arange(len(seed)) - at[row]
    hit = np.flatnonzero(twice)
    np.add.at(out, place[hit], 1)
    np.add.at(out, np.minimum(place[hit] + SEED, len(h)), -1)
    return np.cumsum(out)[:-1] > 0


def of_batch(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Starts and ends of the words, each text's first, and (text, start, length, period) of all runs."""
    begin, end, first = bounds(data, offs)
    near = candidates(hashes(data, begin, end), first)
    raw, out = data.tobytes(), []
    edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
    inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(near))]
    inner = np.unique(inner[near[inner - 1] & near[inner]]) if len(inner) else inner  # stretches end with their text
    ups, downs = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner])), np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
    text = np.searchsorted(first, ups, side="right") - 1
    for k, lo, hi in zip(text.tolist(), ups.tolist(), downs.tolist(), strict=True):
        if hi - lo >= LEAST:
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(raw[b:e], len(number)) for b, e in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)])
            out += [(k, lo - int(first[k]) + start, length, q) for start, length, q in runs_of(ids)]
    return begin, end, first, out


ADDED = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")


def _run(text: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, offs = buffer_of(batch.column(text))
            begin, end, first, found = of_batch(data, offs)
            rows = batch.num_rows
            mine: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
            depth = np.zeros(len(begin) + 1, np.int64)
            for k, start, length, q in found:
                mine[k].append((start, length, q))
                depth[first[k] + start + q] += 1
                depth[first[k] + start + length] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            raw, texts = data.tobytes(), []
            for k in range(rows):
                at = np.arange(first[k], first[k + 1])[~gone[first[k] : first[k + 1]]]
                texts.append(b" ".join([raw[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)]).decode())
            best = [min(m, key=lambda r: (-r[1], r[0], r[2])) if m else (None, None, None) for m in mine]
            longs = [pa.array([len(m) for m in mine], pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(3))]
            longs.append(pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()))
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in m] for m in mine], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([batch.column(keep), *longs, listed, pa.array(texts, pa.string())], names=["_own", *ADDED])

    return run


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_runs``; ``start``, ``length``, ``period``, ``exponent_milli`` (floor of 1000 * length / period) of the longest run (ties:
    the smallest start, then period; null without a run), all long; ``runs``, an array of (start, length, period) by start, then
    period; and ``collapsed``, the words outside all runs or among their first period, joined by one space.

    Words are numbered from 0. A run is a maximal stretch of words with smallest period q, of LEAST words at least and of two periods. One
    scan without a shuffle: no run leaves its row. A null or blank text has no words, no runs and an empty ``collapsed``. Repeated
    rows get the same; further columns stay, those named as above are replaced. An empty table stays empty. A long text that
    repeats itself throughout takes time in the square of its words, by 64 of them an operation.
    """
    store.bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ADDED]
    aside = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    slim = docs.select(aside.alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    one = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([slim.schema["_own"], *(StructField(c, LongType()) for c in ADDED[:5]), StructField("runs", ArrayType(one)), StructField("collapsed", StringType())])
    out = slim.mapInArrow(_run(1, 0), schema)
    return out.select(*[F.col("_own")[c].alias(c) for c in own], *ADDED)

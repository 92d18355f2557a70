"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random to BLOCKS times 8 dimensions in each of TABLES tables, and each
block is decoded to its nearest point of the E8 lattice: the points are the vector's home cell. A
vector also probes the PROBES neighbouring cells (a step by one of the 240 shortest lattice vectors
in one block) that its projection is nearest to. Vectors meet in a cell if it is home to one and
home or probed to the other; then their cosine is verified in double precision.

Copies of a vector are one node, whatever their number. Cells of more than TILE vectors are dealt
to tiles of home and visiting vectors, so no task holds a whole hot cell. Tiles emit counts and
spanning trees, never pairs: a pair met in several cells counts in the first of them, which each
task works out from the two vectors alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import mix

TABLES, BLOCKS, PROBES, SPREAD, TILE, COSINE = 8, 2, 3, 0.4, 1024, 0.95
U = np.uint64


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of D8 and D8 moved by one half."""

    def even(z: np.ndarray) -> np.ndarray:
        f = np.rint(z)
        odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
        d = z[odd] - f[odd]
        k = np.abs(d).argmax(1)
        f[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
        return f

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projection(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8 * dim + 1)
    return rng.normal(0, SPREAD, (TABLES, dim, 8 * BLOCKS)), rng.integers(1, 1 << 62, (TABLES, 8 * BLOCKS), dtype=np.uint64) * U(2) + U(1)


def cells(unit: np.ndarray) -> np.ndarray:
    """Cell keys (n, TABLES, 1 + PROBES) of unit vectors, the home cell first. Sums run in a fixed
    order, so a vector's cells do not depend on the batch it comes in."""
    n, dim = unit.shape
    planes, odd = _projection(dim)
    out = np.empty((n, TABLES, 1 + PROBES), U)
    steps = shortest()
    own = mix(np.arange(TABLES).astype(U) + U(TABLES * dim))  # cells of other tables and lengths are others, the zero point's too
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            y = np.zeros((n, 8 * BLOCKS))
            for j in range(dim):
                y += unit[:, j : j + 1] * planes[t, j]
            best, gain = [], []
            points = np.empty_like(y)
            for b in range(BLOCKS):
                z = y[:, 8 * b : 8 * b + 8]
                c = points[:, 8 * b : 8 * b + 8] = nearest(z)
                dot = np.zeros((n, len(steps)))
                for j in range(8):
                    dot += (z - c)[:, j : j + 1] * steps[:, j]
                top = np.argpartition(-dot, PROBES, axis=1)[:, :PROBES]
                best.append(top + b * len(steps))
                gain.append(np.take_along_axis(dot, top, 1))
            home = ((2 * points).astype(np.int64).view(U) * odd[t]).sum(1, dtype=U)
            out[:, t, 0] = mix(home + own[t])
            best, gain = np.concatenate(best, 1), np.concatenate(gain, 1)
            pick = np.take_along_axis(best, np.argsort(-gain, axis=1, kind="stable")[:, :PROBES], 1)
            for p in range(PROBES):
                block, step = np.divmod(pick[:, p], len(steps))
                move = (2 * steps[step]).astype(np.int64).view(U)
                weight = odd[t].reshape(BLOCKS, 8)[block]
                out[:, t, 1 + p] = mix(home + (move * weight).sum(1, dtype=U) + own[t])
    return out


def first_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell in which a pair counts, from both vectors' cells: of the first table in which they
    meet, their common home or the smaller of the homes that the other one probes."""
    top = U(0xFFFFFFFFFFFFFFFF)
    out, open_ = np.full(len(a), top, U), np.ones(len(a), bool)
    for t in range(TABLES):
        ha, hb = a[:, t, 0], b[:, t, 0]
        at_a = np.where((ha[:, None] == b[:, t]).any(1), ha, top)
        at_b = np.where((hb[:, None] == a[:, t]).any(1), hb, top)
        cell = np.minimum(at_a, at_b)
        now = open_ & (cell != top)
        out[now] = cell[now]
        open_ &= ~now
    return out


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    col = col.cast(pa.large_list(pa.float64()))
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    values = col.values.to_numpy(zero_copy_only=False)
    return values[offs[0] : offs[-1]], offs - offs[0]


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offs = flat(batch.column(1))
        nodes = batch.column(0).to_numpy()
        for dim in np.unique(np.diff(offs)):
            rows = np.flatnonzero(np.diff(offs) == dim)
            for i in range(0, len(rows), 512):
                r = rows[i : i + 512]
                keys = cells(unit_rows(values[offs[r][:, None] + np.arange(dim)])).reshape(len(r), -1)
                home = np.tile(np.arange(1 + PROBES) == 0, TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[r], keys.shape[1])), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(home, len(r)))], names=["node", "cell", "home"])


def _match(cell: int, node: np.ndarray, role: np.ndarray, count: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, ...] | None:
    """Links of one tile: nodes, the copies that each is linked with, and the root of its tree."""
    unit = unit_rows(x)
    h, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    hit_h, hit_q = np.nonzero(unit[h] @ unit[q].T >= least)
    a, b = h[hit_h], q[hit_q]
    keep = (node[a] < node[b]) | ((node[a] > node[b]) & ((role[b] & 4) == 0))
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = cells(unit[used])
    a, b = inverse[: len(a)], inverse[len(a) :]
    own = np.empty(len(a), bool)
    for i in range(0, len(a), 100_000):
        own[i : i + 100_000] = first_cell(keys[a[i : i + 100_000]], keys[b[i : i + 100_000]]) == U(cell & 0xFFFFFFFFFFFFFFFF)
    a, b = a[own], b[own]
    if not len(a):
        return None
    links = np.bincount(a, count[used][b], len(used)) + np.bincount(b, count[used][a], len(used))
    root = np.arange(len(used))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = links > 0
    return node[used][some], links[some].astype(np.int64), node[used][root][some]


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come one after the other, as the rows are sorted by tile; each is held by itself."""
        held: list[pa.RecordBatch] = []

        def close() -> list[tuple[np.ndarray, ...]]:
            if not held:
                return []
            t = pa.Table.from_batches(held).combine_chunks()
            tile = t["tile"].to_numpy()
            cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            node, role, count, cell = (t[c].to_numpy() for c in ("node", "role", "count", "cell"))
            values, offs = flat(t["embedding"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.float64())))
            out = []
            for i, j in zip(cut, np.append(cut[1:], len(tile)), strict=True):
                dim = offs[i + 1] - offs[i]
                if j - i > 1 and offs[j] - offs[i] == dim * (j - i):
                    out.append(_match(int(cell[i]), node[i:j], role[i:j], count[i:j], values[offs[i] : offs[j]].reshape(-1, dim), least))
            return [x for x in out if x is not None]

        def emit(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            at = int(np.searchsorted(tile, tile[-1]))  # where the last tile of the batch begins
            if at or (held and held[-1].column(0)[-1].as_py() != tile[0]):
                if at:
                    held.append(batch.slice(0, at))
                found = close()
                held.clear()
                yield from emit(found)
            held.append(batch.slice(at))
        yield from emit(close())

    return run


def usable(vector: str) -> Column:
    """Neither null nor empty, all components finite, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest key reachable) and
    ``kept`` for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors are linked, repeated rows included. A row with a null
    key is linked like others but never names its component unless all keys there are null (then it is
    null and the row is kept). Further columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    store.bound_batches(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding")).withColumn("ok", usable("embedding"))
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("embedding")))
    good = rows.where("ok")
    tables = store.Tables(spark)
    nodes = store.cut(good.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("count"), F.first("embedding").alias("embedding")), "vectors")
    spots = tables.cut(nodes.select("node", "embedding").mapInArrow(_cells, "node long, cell long, home boolean"), "cells")
    sizes = tables.cut(spots.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("n")).where("homes > 0 AND n > 1"), "sizes")
    dealt = store.with_value(spots, sizes, ["cell"], "n", spots.count()).withColumns({"th": F.ceil(F.col("homes") / TILE).cast("int"), "tq": F.ceil(F.col("n") / TILE).cast("int")})
    h, q = F.pmod(F.xxhash64("node"), F.col("th")).cast("int"), F.pmod(F.xxhash64(F.lit(3), "node"), F.col("tq")).cast("int")
    home = F.col("home").cast("int")
    # roles as bits: 1 as one at home, 2 as a visitor, 4 at home too
    as_home = F.transform(F.sequence(F.lit(0), F.col("tq") - 1), lambda j: F.struct(h.alias("i"), j.alias("j"), F.lit(1).alias("role")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("th") - 1), lambda i: F.struct(i.alias("i"), q.alias("j"), (2 + 4 * home).alias("role")))
    plain = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), (2 + 5 * home).alias("role")))
    places = F.when((F.col("th") == 1) & (F.col("tq") == 1), plain).when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)
    dealt = dealt.select("node", "cell", F.explode(places).alias("p")).select("node", "cell", "p.*").withColumn("tile", F.xxhash64("cell", "i", "j"))
    full = dealt.join(nodes.select("node", "count", "embedding"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = full.select("tile", "cell", "node", "role", "count", "embedding").repartition(parts, "tile").sortWithinPartitions("tile")
    found = store.cut(full.mapInArrow(_tiles(cosine), "node long, links long, root long"), "links")
    tables.drop_all_but()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = store.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "rep", "count").join(member, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("node", "component_id", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "ok", "node").join(known, "node", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))

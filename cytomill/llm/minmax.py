"""Near-duplicate documents by min-max hashing over word shingles.

Every document is its set of distinct WORDS-word shingles. Under each of PERMUTATIONS hash functions
both the smallest and the largest value are kept, so a signature of 2 * PERMUTATIONS unbiased values
costs half the hash evaluations; ROWS values make a band. Documents with equal sets are one node.
Nodes that agree in a band meet in a bucket, large buckets being dealt to tiles. A tile compares
short signatures and proposes pairs; each proposed pair is verified on the full sets:

* round 1 takes a spanning tree of each tile by estimated similarity; tiles differ from band to band,
  so this joins most of a group;
* round 2 takes, in buckets that still hold several components, every pair across components whose
  estimate is above ``least_estimate``, over five standard deviations below the threshold. There only the
  nodes outside a bucket's largest component are compared with all of it, each pair in the first band
  it shares. The texts of nodes with such a pair come to the tile, which verifies pairs until it has
  them joined and emits its spanning trees.

So no pairs of groups are shuffled, and no link between components is left out. The rows of a band follow from the
threshold, so that at the threshold the bands miss a pair with a probability below MISSED.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import LOWER, U, binary, bounds, buffer_of, hashes, mix, pieces, shingles, spans

WORDS, PERCENT, PERMUTATIONS, ROWS, MISSED = 5, 85, 50, 5, 1e-5
FIRST_BANDS, TILE, NARROW_TILE, LEAST_ESTIMATE, GROUP = 6, 1024, 512, 0.65, 64
#: Shingles of each side of a tile whose sets are held together, about.
TILE_SHINGLES = 1 << 20


def band_rows(percent: int) -> int:
    """The most values a band may have, of ROWS and less, for pairs at the threshold to be missed by fewer than MISSED;
    the signature is dealt to bands without a rest."""
    fit = [r for r in range(ROWS, 0, -1) if 2 * PERMUTATIONS % r == 0]
    return next((r for r in fit if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) < MISSED), 1)


def least_estimate(percent: int) -> float:
    """LEAST_ESTIMATE, or less where that is not five standard deviations below the threshold."""
    p = percent / 100
    return min(LEAST_ESTIMATE, p - 5.5 * (p * (1 - p) / (2 * PERMUTATIONS)) ** 0.5)


def lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = buffer_of(col)
    return np.frombuffer(data.tobytes().translate(LOWER), np.uint8), offs


def sets(col: pa.Array, words: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and their offsets; worked out over pieces of about
    ``limit`` bytes, so that only the result grows with the batch."""
    data, offs = lowered(col)
    out, size, i = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        part, cut = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = bounds(part, cut)
        h, at = shingles(hashes(part, starts, ends), first, words)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        out.append(h[new])
        size.append(np.bincount(row[new], minlength=j - i))
        i = j
    return np.concatenate(out), np.cumsum(np.concatenate(size))


def signature(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, 2 * PERMUTATIONS) minima and maxima in turn; texts without shingles get zeros."""
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 1 << 62, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
    flip = rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    out = np.zeros((len(at) - 1, 2 * PERMUTATIONS), U)
    some = np.flatnonzero(np.diff(at))
    step = 1 << 16
    i = 0
    while i < len(some):  # pieces that stay in the cache
        j = max(i + 1, int(np.searchsorted(at[some + 1], at[some[i]] + step, side="right")))
        lo, hi = at[some[i]], at[some[j - 1] + 1]
        part, cut = h[lo:hi], at[some[i:j]] - lo
        for p in range(PERMUTATIONS):
            v = part ^ flip[p]
            v *= odd[p]
            v ^= v >> U(32)
            v *= odd[-1 - p]
            out[some[i:j], 2 * p] = np.minimum.reduceat(v, cut)
            out[some[i:j], 2 * p + 1] = np.maximum.reduceat(v, cut)
        i = j
    return out


def _sign(words: int, rows: int):
    n_bands = 2 * PERMUTATIONS // rows
    odd = np.random.default_rng(12).integers(1, 1 << 62, 2 * PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, at = sets(batch.column(1), words)
            n, some = np.diff(at), np.diff(at) > 0
            total = np.concatenate([np.zeros(1, U), np.cumsum(h, dtype=U)])
            other = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x1234567)), dtype=U)])
            node = mix((total[at[1:]] - total[at[:-1]]) ^ mix((other[at[1:]] - other[at[:-1]]) + n.astype(U)))
            sig = signature(h, at)
            bands = mix((sig * odd).reshape(len(sig), n_bands, rows).sum(2, dtype=U) + np.arange(n_bands).astype(U))
            short = (sig >> U(56)).astype(np.uint8)
            wide = [binary(bands).cast(pa.binary()), binary(short).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(node.view(np.int64), mask=~some), *wide], names=["id", "row_key", "n_shingles", "node", "bands", "short"])

    return run


def _bucket_rows(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n_bands)), pa.array(bands), pa.array(np.tile(np.arange(n_bands, dtype=np.int32), len(node))), pa.array(np.repeat(size, n_bands))], names=["node", "bucket", "band", "size"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, text) as (node, shingles): the sorted set as 64-bit integers."""
        for batch in pieces(batches):
            h, at = sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans(h, at).cast(pa.binary())], names=["node", "shingles"])

    return run


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal short values, freed of what chance alone makes equal."""
    same = np.empty((len(a), len(b)), np.float32)
    for i in range(0, len(a), 64):
        same[i : i + 64] = np.count_nonzero(a[i : i + 64, None] == b[None], axis=2)
    return (same / np.float32(max(1, a.shape[1])) - np.float32(1 / 256)) / np.float32(1 - 1 / 256)


class Roots:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b


def _propose(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning trees of tiles by estimate, the most similar first; rows (tile, node, short) sorted by tile."""
        for t in whole_groups(batches):
            tile, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            short = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(node), -1)
            cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            out = []
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(tile)).tolist(), strict=True):
                if hi - lo < 2:
                    continue
                est = np.triu(_estimates(short[lo:hi], short[lo:hi]), 1)
                i, j = np.nonzero(est >= least)
                roots, left = Roots(hi - lo), hi - lo - 1
                for o in np.argsort(-est[i, j], kind="stable").tolist():
                    if roots.join(int(i[o]), int(j[o])):
                        a, b = int(node[lo + i[o]]), int(node[lo + j[o]])
                        out.append((min(a, b), max(a, b)))
                        left -= 1
                        if not left:
                            break
            if out:
                a, b = zip(*set(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _candidates(band: int, node: np.ndarray, comp: np.ndarray, side: np.ndarray, short: np.ndarray, bands: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile, by row, to be verified here: in different components, likely enough, and not already
    together in an earlier band; and their estimates."""
    x, y = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    est = _estimates(short[x], short[y])
    both = ((side[x] & 2) > 0)[:, None] & ((side[y] & 1) > 0)[None]  # met twice in this tile
    est[(comp[x][:, None] == comp[y][None]) | (both & (node[x][:, None] > node[y][None]))] = -1
    i, j = np.nonzero(est >= least)
    value = est[i, j]
    i, j = x[i], y[j]
    for k in range(band):
        new = bands[i, k] != bands[j, k]
        i, j, value = i[new], j[new], value[new]
    return i, j, value


def _tile_arrays(t: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Rows (tile, band, node, comp, side, short, bands, ...); the sets stay in Arrow."""
    tile, band, node, comp, side = (t.column(i).to_numpy() for i in range(5))
    short = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(node), -1)
    return tile, band, node, comp, side, short, np.frombuffer(b"".join(t.column(6).to_pylist()), np.int64).reshape(len(node), -1)


def _doubtful(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of tiles that have a candidate pair."""
        for t in whole_groups(batches):
            tile, band, node, comp, side, short, bands = _tile_arrays(t)
            cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            keep = np.zeros(len(tile), bool)
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(tile)).tolist(), strict=True):
                i, j, _ = _candidates(int(band[lo]), node[lo:hi], comp[lo:hi], side[lo:hi], short[lo:hi], bands[lo:hi], least)
                keep[lo + i] = keep[lo + j] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in t.columns[:5]], names=["tile", "band", "node", "comp", "side"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _settle(percent: int):
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verify the candidate pairs of tiles; rows as in _tile_arrays with the sets behind."""
        for t in whole_groups(batches):
            tile, band, node, comp, side, short, bands = _tile_arrays(t)
            cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            out = []
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(tile)).tolist(), strict=True):
                i, j, value = _candidates(int(band[lo]), node[lo:hi], comp[lo:hi], side[lo:hi], short[lo:hi], bands[lo:hi], least)
                if not len(i):
                    continue
                held: dict[int, np.ndarray] = {}

                def of(k: int, held=held, column=t.column(7), lo=lo) -> np.ndarray:
                    if k not in held:
                        held[k] = np.frombuffer(column[lo + k].as_buffer(), U)
                    return held[k]

                roots, first = Roots(hi - lo), {}
                for k, c in enumerate(comp[lo:hi].tolist()):  # what is joined already counts as one
                    roots.join(k, first.setdefault(c, k))
                order = np.argsort(-value, kind="stable")
                for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    if roots.find(a) != roots.find(b) and _similar(of(a), of(b), percent):
                        roots.join(a, b)
                        out.append((int(node[lo + a]), int(node[lo + b])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that none ends inside a group; rows are sorted by the first column."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = int(np.argmax(key == key[-1]))
        if at or (held and held[-1].column(0)[-1].as_py() != key[0]):
            if at:
                held.append(batch.slice(0, at))
            yield joined()
            held.clear()
        held.append(batch.slice(at))
    if held:
        yield joined()


def _verify(percent: int):
    """Rows sorted by group, the hub's first: (group, node, hub, shingles). Every node of a group is compared with its
    hub, whose set alone is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, np.zeros(0, U)
        for t in batches:
            out = []
            group, node, hub = (t.column(i).to_pylist() for i in range(3))
            for k, (g, n, h) in enumerate(zip(group, node, hub, strict=True)):
                own = np.frombuffer(t.column(3)[k].as_buffer(), U)
                if n == h:
                    at, base = (g, h), own.copy()
                elif at != (g, h):
                    raise RuntimeError("a hub's set is missing")
                elif _similar(base, own, percent):
                    out.append((h, n))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def tree_tiles(rows: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """Buckets as tiles (tile, node, short), each node in one tile of its bucket."""
    k = F.ceil(F.col("n") / TILE).cast("int")
    r = rows.select(F.xxhash64("bucket", F.pmod(F.xxhash64("bucket", "node"), k)).alias("tile"), "node")
    return r.join(nodes.select("node", "short"), "node").select("tile", "node", "short").repartition(parts, "tile").sortWithinPartitions("tile")


def open_tiles(rows: DataFrame, comps: DataFrame, nodes: DataFrame, parts: int, tables: store.Tables) -> DataFrame:
    """Buckets with several components as tiles (tile, band, node, comp, side, short, bands): the nodes outside the
    largest component (side 1) against all nodes (side 2)."""
    r = tables.cut(rows.join(comps, "node", "left").select("bucket", "band", "node", "size", F.coalesce("component", "node").alias("comp")), "placed")
    sizes = r.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("n", "comp", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > most.n")

    def tiles(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / NARROW_TILE), F.ceil(size / TILE_SHINGLES)).cast("int")

    outside = tiles(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    sizes = tables.cut(sizes.select("bucket", "n", F.col("most.comp").alias("most"), outside.alias("k1"), tiles(F.col("n"), F.col("size")).alias("k2")), "open")
    r = store.with_value(r, sizes, ["bucket"], "n", r.count())
    i, j = F.pmod(F.xxhash64("node"), F.col("k1")).cast("int"), F.pmod(F.xxhash64("node"), F.col("k2")).cast("int")
    one = F.transform(F.sequence(F.lit(0), F.col("k2") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), (F.lit(1) + F.when(x == j, 2).otherwise(0)).alias("side")))
    two = F.filter(F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(2).alias("side"))), lambda p: (F.col("comp") == F.col("most")) | (p["i"] != i))
    r = r.select("bucket", "band", "node", "comp", F.explode(F.when(F.col("comp") != F.col("most"), F.concat(one, two)).otherwise(two)).alias("p"))
    r = r.select(F.xxhash64("bucket", "p.i", "p.j").alias("tile"), "band", "node", "comp", F.col("p.side").cast("int").alias("side"))
    return described(r, nodes).repartition(parts, "tile").sortWithinPartitions("tile")


def described(r: DataFrame, nodes: DataFrame) -> DataFrame:
    return r.join(nodes.select("node", "short", "bands"), "node").select("tile", "band", "node", "comp", "side", "short", "bands")


def sets_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, tables: store.Tables, name: str) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``, each worked out from one row's text and written once."""
    need = tables.cut(wanted.distinct().join(nodes.select("node", "row_key"), "node").select("node", "row_key"), f"{name}-need")
    found = texts.join(store.small(need, need.count()), "row_key").select("node", "text").mapInArrow(_sets(words), "node long, shingles binary")
    return tables.cut(found.dropDuplicates(["node"]), name)


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int, parts: int, tables: store.Tables) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough. Pairs are grouped by the node that has
    more of them, in groups of about GROUP, so a hub's set travels once for many of its mates."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("d"))
    ends = tables.cut(ends, "ends")
    held = sets_of(ends.select("node"), texts, nodes, words, tables, "sets")
    p = pairs
    for end in ("a", "b"):
        p = store.with_value(p, ends.select(F.col("node").alias(end), F.col("d").alias(f"d{end}")), [end], f"d{end}", 2 * pairs.count())
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("mate"), F.greatest("da", "db").alias("d"))
    p = p.withColumn("group", F.xxhash64("hub", F.pmod(F.xxhash64("mate"), F.ceil(F.col("d") / GROUP))))
    need = p.select("group", F.col("mate").alias("node"), "hub").union(p.select("group", "hub", "hub").distinct())
    rows = need.join(held, "node").withColumn("mate", F.col("node") != F.col("hub"))
    rows = rows.repartition(parts, "group").sortWithinPartitions("group", "hub", "mate").select("group", "node", "hub", "shingles")
    return rows.mapInArrow(_verify(percent), "a long, b long")


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id`` (the key), ``row_key`` (a hash of key and text), ``n_shingles``, ``component`` and ``component_id`` (its
    smallest key) for every row; rows of equal ``component`` are linked. Both are null for texts without shingles."""
    spark = docs.sparkSession
    rows_a_band, least = band_rows(percent), least_estimate(percent)
    store.bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(key, text).alias("row_key"))
    kind = d.schema["id"].dataType.simpleString()
    signed = store.cut(d.mapInArrow(_sign(words, rows_a_band), f"id {kind}, row_key long, n_shingles long, node long, bands binary, short binary"), "signed")
    tables = store.Tables(spark)
    rep = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    nodes = store.cut(rep, "nodes")
    rows = tables.cut(nodes.select("node", "bands", "size").mapInArrow(_bucket_rows(2 * PERMUTATIONS // rows_a_band), "node long, bucket long, band int, size long"), "rows")
    multi = tables.cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "multi")
    buckets = tables.cut(store.with_value(rows, multi, ["bucket"], "n", rows.count()), "buckets")
    tables.drop("rows", "multi")
    texts = d.select("row_key", "text")
    pairs = tables.cut(tree_tiles(buckets.where(F.col("band") < FIRST_BANDS), nodes, parts).mapInArrow(_propose(least), "a long, b long").distinct(), "pairs")
    trees = store.cut(verified(pairs, texts, nodes, words, percent, parts, tables), "verified")
    tables.drop_all_but("buckets")
    left = open_tiles(buckets, store.components(trees), nodes, parts, tables).mapInArrow(_doubtful(least), "tile long, band int, node long, comp long, side int")
    left = tables.cut(left, "left")
    held = sets_of(left.select("node"), texts, nodes, words, tables, "sets")
    full = described(left, nodes).join(held, "node").select("tile", "band", "node", "comp", "side", "short", "bands", "shingles")
    settled = full.repartition(parts, "tile").sortWithinPartitions("tile", "node", "side").mapInArrow(_settle(percent), "a long, b long")
    settled = store.cut(settled, "settled")
    tables.drop_all_but()
    store.forget_shuffles(spark)
    edges = trees.union(settled)
    member = store.components(edges)
    known = nodes.select("node", "rep").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(smallest, "component").select("node", "component", "component_id")
    return signed.select("id", "row_key", "n_shingles", "node").join(known, "node", "left").drop("node")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable) and ``kept`` for every row.

    Words are lower-cased in A-Z. A text with fewer than ``words`` words is one shingle; a null text or
    one without words has none and links with nothing. Rows with equal sets are linked, repeated rows
    included; rows that share a key are told apart by their texts. A row with a null key is linked like
    others but names no component unless all keys there are null (then null, and the row is kept).
    """
    out = linked(docs, text, key, words, percent)
    component: Column = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


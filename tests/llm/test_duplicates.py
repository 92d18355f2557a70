"""Lattice hashing, min-max hashing and substring deduplication against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomill.llm import lattice, minmax, repeats, store

from .fixtures import empty, hard, hard_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def closure(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(base)]
    for k in range(40):  # near, borderline and far from vector 0..9
        v = base[k % 10] + rng.normal(size=16) * (0.02 + 0.03 * (k // 10))
        rows.append((100 + k, v.astype("float32").tolist()))
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, [2 * x for x in rows[3][1]])]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(400 + i, v) for i, v in enumerate(bad)] + [(3, rows[3][1])]


@pytest.mark.parametrize("tile", [1024, 4])
def test_lattice_finds_what_brute_force_finds(spark, tile, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(9))
    got = sorted(map(tuple, lattice.near_duplicates(df).collect()))
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n_links = [sum(i in p for p in links) for i in range(len(rows))]
    comp = closure(len(rows), links)
    least = [min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))]
    assert got == sorted((rows[i][0], n_links[i], least[i], rows[i][0] == least[i]) for i in range(len(rows)))


def test_lattice_cells_do_not_depend_on_the_batch():
    x = lattice.unit_rows(np.random.default_rng(1).normal(size=(50, 24)))
    whole = lattice.cells(x)
    assert all((lattice.cells(x[i : i + 1])[0] == whole[i]).all() for i in range(50))


def test_lattice_lengths_do_not_share_cells(spark):
    """Many vectors have the zero point as home; those of another length must not come into its cell."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for dim in (16, 24):
        base = rng.normal(size=(400, dim))
        for k, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.02])):
            rows.append((1000 * dim + k, v.tolist()))
        unit = lattice.unit_rows(np.array([v for _, v in rows[-800:]]))
        want |= {1000 * dim + k: int(n) for k, n in enumerate((unit @ unit.T >= lattice.COSINE).sum(1) - 1)}
    one, other = (set(lattice.cells(lattice.unit_rows(np.array([v for _, v in rows if len(v) == d]))).ravel().tolist()) for d in (16, 24))
    assert not one & other
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df).collect()} == want


def test_lattice_points_are_nearest():
    y = np.random.default_rng(2).normal(size=(200, 8)) * 2
    near = lattice.nearest(y)
    steps = lattice.shortest()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    d = ((y - near) ** 2).sum(1)
    assert all((((y[i] - near[i] - steps) ** 2).sum(1) >= d[i] - 1e-9).all() for i in range(200))


@pytest.mark.parametrize("dim", [32, 64, 256])
def test_lattice_recall_at_the_threshold(dim):
    """Pairs at a cosine of 0.95 exactly, the hardest to find: nearly all meet in a cell."""
    rng = np.random.default_rng(dim)
    a = lattice.unit_rows(rng.normal(size=(2000, dim)))
    o = rng.normal(size=a.shape)
    o = lattice.unit_rows(o - (o * a).sum(1, keepdims=True) * a)
    b = lattice.COSINE * a + np.sqrt(1 - lattice.COSINE**2) * o
    met = lattice.first_cell(lattice.cells(a), lattice.cells(b)) != np.uint64(0xFFFFFFFFFFFFFFFF)
    assert met.mean() >= 0.999


def test_lattice_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT_ROWS", 3)
    monkeypatch.setattr(store, "BROADCAST_ROWS", 1500)
    test_lattice_finds_what_brute_force_finds(spark, 1024, monkeypatch)


def test_lattice_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def check_minmax(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = sorted(map(tuple, minmax.near_duplicates(df).collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = closure(len(rows), links)
    ids = [[r[0] for j, r in enumerate(rows) if comp[j] == comp[i] and r[0] is not None] for i in range(len(rows))]
    least = [min(x) if x else None for x in ids]
    assert got == sorted(((rows[i][0], len(sets[i]), least[i], rows[i][0] == least[i]) for i in range(len(rows))), key=str)


def test_minmax_hard_rows(spark):
    check_minmax(spark, [r[:2] for r in hard_rows()])


@pytest.mark.parametrize("tile", [1024, 4])
def test_minmax_groups_of_all_kinds(spark, tile, monkeypatch):
    """Families whose members are linked with their origin, with some others, or just not."""
    monkeypatch.setattr(minmax, "TILE", tile)
    monkeypatch.setattr(minmax, "NARROW_TILE", tile)
    if tile == 4:  # hot buckets by broadcast, tiles bounded by their sets, hubs in several groups
        monkeypatch.setattr(minmax, "TILE_SHINGLES", 600)
        monkeypatch.setattr(minmax, "GROUP", 3)
        monkeypatch.setattr(store, "HOT_ROWS", 3)
        monkeypatch.setattr(store, "BROADCAST_ROWS", 1000)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(8):
        words = prose(50 + family, 150).split()
        for k in range(12):
            w = list(words)
            for at in rng.choice(150, 1 + family // 2, replace=False):
                w[at] = f"changed{rng.integers(1000)}"
            rows.append((1000 - len(rows), " ".join(w)))
    check_minmax(spark, rows)


def test_minmax_empty(spark):
    assert minmax.near_duplicates(empty(spark)).count() == 0


def kept_words(rows, length):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for w in docs:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] = seen.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), gone))
    return out


def check_repeats(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = repeats.remove_repeats(df, length).collect()
    want = kept_words(rows, length)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted((str(k), *w[:3]) for (k, _), w in zip(rows, want, strict=True))
    for r in got:
        assert sum(b - a for a, b in zip(r["repeats"][::2], r["repeats"][1::2], strict=True)) == r["n_removed"]


def test_repeats_hard_rows(spark):
    check_repeats(spark, [r[:2] for r in hard_rows()], 35)


def test_repeats_clashing_names_and_hot_keys(spark, monkeypatch):
    """Extra columns may have any name; hot anchors, blocks and windows come by broadcast and give the same rows."""
    monkeypatch.setattr(store, "HOT_ROWS", 5)
    passage = prose(91, 60)
    rows = [(i, prose(i, 10) + " " + passage + (" " + prose(92, 40) if i % 3 else "") + f" tail{i % 4}") for i in range(60)]
    check_repeats(spark, rows, 35)
    names = ["row_key", "_text", "_k", "_own", "_starts", "_row_key", "window", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    got = repeats.remove_repeats(df, 35)
    assert got.columns[:10] == ["doc_id", "text", *names] and all(r["_k"] == "_k" and r["n_removed"] >= 60 for r in got.collect())


def test_repeats_partial_matches(spark):
    """Few words, so that windows match in parts, overlap, repeat within a text and extend by different lengths."""
    rng = np.random.default_rng(4)
    pool = [prose(70 + i, 30, 5).split() for i in range(6)]
    rows = []
    for k in range(40):
        w = []
        for _ in range(int(rng.integers(1, 6))):
            p = pool[rng.integers(6)]
            a = int(rng.integers(0, 20))
            w += p[a : a + int(rng.integers(5, 30))]
        rows.append((k, " ".join(w)))
    check_repeats(spark, rows, 12)
    check_repeats(spark, [(1, "a " * 100), (2, "a " * 11), (3, "a " * 12)], 12)


def test_repeats_empty(spark):
    assert repeats.remove_repeats(empty(spark)).count() == 0
    assert repeats.remove_repeats(hard(spark), 35).columns[-4:] == ["n_words", "n_removed", "kept_text", "repeats"]


def test_query_digest(spark, tmp_path):
    from cytomill.llm import queries

    hard(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op6_seed_and_extend(spark, str(tmp_path)).collect()}
    rows = [r[:2] for r in hard_rows()]
    assert got == {(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for (k, _), (n, m, t, _) in zip(rows, kept_words(rows, 35), strict=True)}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = dict(store.components(spark.createDataFrame(links, "a long, b long")).collect())
    comp = closure(600, links)
    assert got == {i: comp[i] for i in {x for p in links if p[0] != p[1] for x in p}}
    assert store.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_components_of_hubs_and_long_paths(spark, broadcast, monkeypatch):
    """Hubs beyond the bound and paths of many rounds, with minima broadcast whole or by hot keys."""
    monkeypatch.setattr(store, "BROADCAST_ROWS", max(broadcast, 40))
    monkeypatch.setattr(store, "HOT_ROWS", 8)
    links = [(1000, i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(150)] + [(3000 + (i * 7) % 64, 3000 + (i * 7 + 7) % 64) for i in range(63)]
    got = dict(store.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect())
    comp = closure(4000, links)
    assert got == {i: comp[i] for i in {x for p in links for x in p}}

"""Suffix-array deduplication, filter interactions and periodic runs against brute force and their SQL."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytomill.llm import audit, periodic, queries, suffixes

from .fixtures import empty, hard, hard_rows, prose
from .test_learned import WORD


def copied_rows():
    """Passages shared by many texts, whole copies, self-repeats, near copies, letters of two bytes, a phrase among other words."""
    rng = random.Random(4)
    passage, other, phrase = prose(20, 30), prose(21, 25) + " éé", "the phrase that every text has in it somewhere, "
    rows = [(i, f"{prose(100 + i, 12)} {passage[rng.randrange(40):]} {prose(200 + i, 5)} {phrase}{prose(300 + i, 9)}") for i in range(30)]
    rows += [(40 + i, other if i % 2 else other + prose(400 + i, 6)) for i in range(8)]
    rows += [(60, passage + " " + passage + " " + other), (61, "ab" * 300), (62, "b" + "ab" * 80), (63, prose(7, 60)[:350] + "X" + prose(7, 60)[351:]), (64, prose(7, 60)), (65, "x" * 39), (66, "x" * 40)]
    rng.shuffle(rows)
    return rows


def plain_earlier(rows, length):
    """(n_bytes, n_removed, n_spans, kept) by the rank of each row; equal ranks are one document."""
    seen: dict[bytes, tuple] = {}
    data = {rank: (text or "").encode() for rank, text in rows}
    for rank in sorted(data):
        for i in range(len(data[rank]) - length + 1):
            seen.setdefault(data[rank][i : i + length], (rank, i))
    out = {}
    for rank, x in data.items():
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] < (rank, i):
                gone[i : i + length] = True
        edge = np.diff(gone.astype(int), prepend=0)
        out[rank] = (len(x), int(gone.sum()), int((edge > 0).sum()), bytes(b for b, g in zip(x, gone, strict=False) if not g))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_earlier_strings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_KINDS", hot)
    rows = copied_rows() + [r[:2] for r in hard_rows() if r[0] != 9] + [(5, prose(1, 120)), (None, prose(8, 80) + "."), (None, prose(1, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumns({"n_bytes": F.lit("clash"), "_text": F.lit(1), "a.b": F.lit(2)})
    got = suffixes.remove_earlier(df, length=40).collect()
    assert len(got) == len(rows) and got[0]["a.b"] == 2
    want = plain_earlier([((r["doc_id"] is None, r["doc_id"] or 0, r["h"]), r["text"]) for r in got], 40)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"] is None, r["doc_id"] or 0, r["h"]], r["doc_id"]
        x, at = (r["text"] or "").encode(), list(zip(r["spans"][::2], r["spans"][1::2], strict=True))
        assert sum(b - a for a, b in at) == r["n_removed"] and all(b < c for (_, b), (c, _) in itertools.pairwise(at)) and all(0 <= a < b <= len(x) for a, b in at)
    assert sum(r["n_removed"] > 0 for r in got) > 30


def test_earlier_strings_of_empty_tables(spark):
    assert suffixes.remove_earlier(empty(spark)).count() == 0
    none = suffixes.remove_earlier(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string"))
    assert {(r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in none.collect()} == {(0, 0, b""), (5, 0, b"short")}


def test_blocks_hold_every_window_once(monkeypatch):
    texts = pa.array([prose(1, 300), "x" * 500, "", "é" * 90, prose(2, 50), "short", None], pa.large_string())
    data, offs = suffixes.buffer_of(texts)
    for stretch in (1 << 21, 37, 200):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        seen = Counter()
        for anchor, _, row, place in suffixes.blocks(data, offs, 60):
            for a, r, p in zip(anchor.tolist(), row.tolist(), place.tolist(), strict=True):
                for i in range(p & 1023):
                    seen[r, (p >> 20) + i] += 1
        assert seen == Counter((r, i) for r in range(len(offs) - 1) for i in range(int(offs[r + 1] - offs[r]) - 60 + 1))


def test_suffix_sort_equals_a_plain_sort():
    rng = np.random.default_rng(5)
    for letters, length in ((2, 12), (1, 33), (4, 100), (26, 40)):
        data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        size = rng.integers(1, 60, 70)
        at = rng.integers(0, len(data) - length + 1, size.sum())
        order, equal = suffixes.merge_sort(data, at, size, length)
        plain, same = suffixes.plain_sort(data, at, size, length)
        first = np.cumsum(size) - size
        same[first] = False  # groups do not meet
        assert (order == plain).all() and (equal == same).all()


def test_suffix_sort_is_mended_after_a_collision(monkeypatch):
    """Hashes that are all alike are found out, and the bytes decide."""
    rows = [b"abcdefghij" * 6, b"abcdefghij" * 5 + b"0123456789", b"abcdefghij" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array([(0 << 20) + (30 << 10) + 11] * 3), pa.array(rows, pa.binary())], names=["anchor", "place", "raw"])
    want = [a.tolist() for a in suffixes.later(batch, 50)]
    assert sorted(zip(*want, strict=True)) == [(1, 0), *((2, i) for i in range(11))]
    monkeypatch.setattr(suffixes.Prefixes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    with pytest.raises(suffixes.Collision):
        suffixes.merge_sort(np.frombuffer(b"".join(rows), np.uint8), np.array([0, 60]), np.array([2]), 60)
    assert sorted(zip(*(a.tolist() for a in suffixes.later(batch, 50)), strict=True)) == sorted(zip(*want, strict=True))


def plain_runs(words):
    """All runs by their definition."""
    n, out = len(words), []
    for i in range(n):
        for j in range(i + 12, n + 1):
            part = words[i:j]
            q = next(q for q in range(1, len(part) + 1) if part[q:] == part[: len(part) - q])
            grows = (i > 0 and words[i - 1] == words[i - 1 + q]) or (j < n and words[j] == words[j - q])
            if len(part) >= max(12, 2 * q) and not grows:
                out.append((i, j - i, q))
    return out


def run_texts():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(5, 48))) for k in range(40)]
    texts += [" ".join("abcd"[i % 4] for i in range(30)) + " x y " + " ".join("pq"[i % 2] for i in range(25)), "a " * 60, "a b " * 5 + "a", "a b c d e f a b c d e f", "a b c d e f a b c d e", "a b c d e f a b c d e f\n\x1cg a"]
    texts += [" ".join([*(f"u{i}" for i in range(9)), *(["v", "w", "z", "é"] * 6), *(f"t{i}" for i in range(9)), *(["v", "w", "z", "é"] * 4)])]
    return texts


def test_runs_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(run_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "_own": F.lit(3)}).repartition(3)
    for r in periodic.find_runs(df).collect():
        words = WORD.findall(rows[r["doc_id"]][1])
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want and r["n_runs"] == len(want) and r["_own"] == 3
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)


def test_runs_of_hard_rows(spark):
    got = periodic.find_runs(hard(spark)).collect()
    assert len(got) == len(hard_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[12]["n_runs"] == 1 and (by[12]["start"], by[12]["length"], by[12]["period"]) == (0, 180, 3) and by[12]["collapsed"] == "the same line"
    assert by[13]["period"] == 5 and by[1]["n_runs"] == 0 and by[1]["collapsed"] == "" and by[16]["n_runs"] == 0
    assert periodic.find_runs(empty(spark)).count() == 0


def test_runs_of_a_long_repetition():
    """A text of one repeated word ends with its first lag; one of a long period has it found among many lags."""
    assert periodic.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    ids = np.random.default_rng(1).integers(0, 50, 3000)
    assert periodic.runs_of(np.concatenate([ids, ids, ids[:100], [77]])) == [(0, 6100, 3000)]


def plain_interactions(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        rows.append((part or "", {f for f in bad if bad[f]}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(now)
                out[part, order, step] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audit_tables():
    rng = random.Random(8)
    docs = [(r[0], r[1], r[3]) for r in hard_rows()]
    for i in range(100, 180):
        t = prose(rng.randrange(30), rng.choice([30, 60, 400]), rng.choice([20, 5000]))
        t = t.upper() if rng.random() < 0.2 else t
        docs.append((i, t + (" 5 % off" if rng.random() < 0.3 else ""), rng.choice(["a", "b", "", None])))
    docs += [(None, docs[-1][1], "a"), (500, "", "only blank"), (501, "", "only blank")]
    labels = [(i, rng.choice([0, 1]), rng.choice([0, 1])) for i in range(100, 180, 2)] + [(None, 1, 1), (101, None, None), (102, 1, 0), (102, 0, 1), (6, 1, 0)]
    return docs, labels


def test_interactions_equal_brute_force_and_sql(spark, tmp_path):
    docs, labels = audit_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"A": F.lit(1), "n": F.lit(2)}).repartition(3)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(d, m).collect()
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    mine = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in counts) for r in got if not r["is_total"]}
    assert mine == plain_interactions(docs, labels) and len(got) == len(mine) + 600
    total = {(r["filter_order"], r["step"]): r["kept"] for r in got if r["is_total"]}
    assert all(total[o, s] == sum(v[0] for (_, oo, ss), v in mine.items() if (oo, ss) == (o, s)) for o, s in total)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    m.write.parquet(str(tmp_path / "labels.parquet"))
    equals_sql(spark, tmp_path, "op12_filter_interactions")


def test_interactions_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(empty(spark), none).count() == 0
    (rows,) = [audit.interactions(spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string"), none).where("NOT is_total").collect()]
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120


def equals_sql(spark, path, name):
    df = queries.QUERIES[name](spark, str(path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        if (path / f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


@pytest.mark.parametrize("name", ["op11_hash_suffix_sort", "op13_bit_parallel_runs"])
def test_query_equals_its_sql(spark, tmp_path, name):
    rows = [*copied_rows(), *((100 + i, t) for i, t in enumerate(run_texts())), *((200 + i, prose(i, 40 + 7 * i)) for i in range(60)), (900, None), (901, ""), (902, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    equals_sql(spark, tmp_path, name)


def test_run_query_plants_as_the_contract_says(spark, tmp_path):
    import zlib

    rows = [(i, prose(i, 30 + i % 50)) for i in range(200)] + [(None, "a b c"), (201, None), (210, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op13_bit_parallel_runs(spark, str(tmp_path)).collect()}
    some = 0
    for k, t in rows:
        w = WORD.findall(t or "")
        if k is not None and zlib.crc32(str(k).encode()) % 10 == 0 and w:
            g, n = zlib.crc32(str(k).encode()) // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            some += 1
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[k]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got[k]["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert some > 8

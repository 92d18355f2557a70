"""WARC files, packing and BPE against brute force and round trips."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomill.llm import packing, queries, warc, wordbpe

from .fixtures import empty, hard, hard_rows, prose

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", f"<p>{prose(rng.randint(0, 40), 30)}</p>") for i in range(200)]
    return rows + [(300, None, None), (301, "http://ü/ a\r\nEvil: 1", ""), (302, "http://y", "é" * 70_000), (5, rows[5][1], rows[5][2]), (None, "http://z", rows[7][2]), (None, "http://z", "only here")]


def headers(path):
    with open(path, "rb") as f:
        return [warc.parse(m)[0] for m in warc.members(f)]


@pytest.mark.parametrize("ids", [[*range(1, 2000), 10**9], [*range(1, 2000), 1 << 60], [-(1 << 63), *range(500), (1 << 63) - 1], [k * k * k for k in range(1500)], [5], [None, 5]])
def test_warc_shards_of_sparse_ids(spark, tmp_path, ids):
    """Shards of about equal bytes and ascending ids wherever the ids lie."""
    df = spark.createDataFrame([(i, f"u{i}", f"{i} " * 30) for i in ids], "page_id long, url string, html string")
    manifest = warc.write(df, str(tmp_path / "a"), shard_bytes=60_000).orderBy("file").collect()
    total = sum(len(f"{i} " * 30) + 512 for i in ids)
    assert len(manifest) >= total / 60_000 and max(f["records"] for f in manifest) <= 2 * 60_000 / 512
    order = [int(f["x-page-id"]) if "x-page-id" in f else None for m in manifest for f in headers(tmp_path / "a" / m["file"]) if f["warc-type"] != "warcinfo"]
    assert order == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_warc_hot_ids_are_dealt(spark, tmp_path):
    """A third of the rows without an id, a third with one id, one row many times: many shards, unique record ids."""
    rows = [(None, "u", f"a {i}") for i in range(400)] + [(7, "u", f"b {i}") for i in range(400)] + [(9, "same", "x" * 50)] * 1000 + [(11, "v", "x" * 50), (None, None, "x" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = warc.write(df, str(tmp_path / "a"), shard_bytes=30_000).collect()
    found = [f for m in manifest for f in headers(tmp_path / "a" / m["file"]) if f["warc-type"] != "warcinfo"]
    assert len(found) == len(rows) and max(m["records"] for m in manifest) < 200
    ids = {f["warc-record-id"] for f in found}
    assert len(ids) == len(rows)
    revisits = [f for f in found if f["warc-type"] == "revisit"]
    assert len(revisits) == 1001 and {f["x-refers-to-page-id"] for f in revisits} == {"11"} and all(f["warc-refers-to"] in ids for f in revisits)


def test_warc_refuses_other_keys(spark, tmp_path):
    with pytest.raises(TypeError):
        warc.write(spark.createDataFrame([("a", None, "x")], "page_id string, url string, html string"), str(tmp_path / "a"))
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path))


@pytest.mark.parametrize("least", [0, 100_000])
def test_warc_round_trip(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    manifest = [r.asDict() for r in warc.write(df, str(tmp_path / "a"), min_bytes=least, shard_bytes=20_000, file_bytes=5_000).orderBy("file").collect()]
    assert len(manifest) > 5 and sum(f["records"] for f in manifest) == len(rows)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted([f["file"] for f in manifest] + ["manifest"])
    last = collections.defaultdict(lambda: None)
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(k, last[h or ""] or 0)
    want = collections.Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        refers = last[h or ""] if last[h or ""] is not None and last[h or ""] != k else None
        want[k, "revisit" if refers is not None else "response", refers, base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw), None if refers is not None else raw] += 1
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    # the same rows in another order give the same bytes
    again = warc.write(df.repartition(7), str(tmp_path / "b"), min_bytes=least, shard_bytes=20_000, file_bytes=5_000)
    assert [r.asDict() for r in again.orderBy("file").collect()] == manifest
    ids = [f["warc-record-id"] for m in manifest for f in headers(tmp_path / "a" / m["file"])]
    known = {f["warc-record-id"] for m in manifest for f in headers(tmp_path / "a" / m["file"]) if f["warc-type"] == "response"}
    assert len(ids) == len(set(ids)) and all(f["warc-refers-to"] in known for m in manifest for f in headers(tmp_path / "a" / m["file"]) if f["warc-type"] == "revisit")
    for f in manifest:
        raw = (tmp_path / "a" / f["file"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and gzip.decompress(raw).count(b"WARC/1.1\r\n") == f["records"] + 1


def test_warc_damage_is_found(spark, tmp_path):
    warc.write(spark.createDataFrame(pages()[:5], "page_id long, url string, html string"), str(tmp_path / "a"))
    path = next((tmp_path / "a").glob("*.gz"))
    path.write_bytes(b"".join(gzip.compress(m.replace(b"<p>", b"<q>")) for m in warc.members(open(path, "rb"))))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path / "a")).collect()


def test_warc_empty(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a")).count() == 0
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(0)
    tight, used = 400_000, {}
    for cap in ((1024, 1024, 1024 * 1024), (1024, 3, 1024 * 1024), (1024, 1024, tight)):
        length = rng.integers(1, 601, 3000)
        bins, offset = packing.best_fit(length, cap)
        used[cap] = max((length[bins == b] ** 2).sum() for b in np.unique(bins))
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offset[own])]
            assert length[own].sum() <= cap[0] and len(own) <= cap[1] and (length[own] ** 2).sum() <= cap[2]
            assert (offset[own] == np.cumsum(length[own]) - length[own]).all()
    assert used[1024, 1024, 1024 * 1024] > tight  # without the bound on attention some sequence goes beyond it
    assert packing.best_fit(np.zeros(0, np.int64), (4, 4, 16))[0].size == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), (5, 5, 25))


def test_packing_is_tight():
    length = np.random.default_rng(1).integers(1, 1025, 5000)
    bins, _ = packing.best_fit(length, (1024, 1024, 1 << 20))
    assert len(np.unique(bins)) <= 1.02 * length.sum() / 1024
    assert len(np.unique(packing.best_fit(np.ones(2048, np.int64), (1024, 1024, 1 << 20))[0])) == 2


def test_packing_limits_and_large_keys(spark):
    """Keys beyond 2**53 beside null ones stay as they are, and each capacity binds in whole runs."""
    path = P.path("byte_bpe_50k.json")
    rows = [((1 << 53) + 1, "a"), ((1 << 60) + 7, "b c"), (None, "d"), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, path).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows) and len({r["sequence_id"] for r in got}) == 1
    many = spark.createDataFrame([(i, None) for i in range(2000)], "doc_id long, text string")
    assert packing.pack(many, path).select("sequence_id").distinct().count() == 2
    assert packing.pack(many, path, max_docs=100).select("sequence_id").distinct().count() == 20
    words = spark.createDataFrame([(i, prose(i, 30)) for i in range(40)], "doc_id long, text string")
    wide = {}
    for most in (None, 30_000):
        sums = collections.Counter()
        for r in packing.pack(words, path, max_attention=most).collect():
            sums[r["sequence_id"]] += r["length"] ** 2
        wide[most] = max(sums.values())
    assert wide[30_000] <= 30_000 < wide[None]
    named = packing.pack(words.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text"), path).collect()
    assert {r["doc_id"] for r in named} == {f"k{i}" for i in range(40)}


def test_packing_hard_rows(spark):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(hard(spark).withColumn("piece", F.lit("clash")), path, with_ids=True).collect()
    want = collections.Counter()
    for r in hard_rows():
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // 1024)
        at = 0
        for p in range(n):
            stop = len(ids) - 1024 * (n - 1 - p)
            raw = np.array(ids[at:stop], "<u4").tobytes()
            want[r[0], p, at, stop - at, zlib.crc32(raw), raw] += 1
            at = stop
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_word_table_equals_the_library(spark, block, monkeypatch):
    monkeypatch.setattr("cytomill.llm.blocks.BLOCK_BYTES", block)
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    more = ["İstanbul ΣΑΣ ſ ﬁ é Å", "<|startoftext|>a<|endoftext|> <|endoftext|", "it's we'll I'VE 'd ''s", "\x1c\x1da\x85b c　d", "日本語 ½ ²3 ४ 😀👍🏽", "<<|endoftext|>>", "áͅb"]
    rows = [r[:2] for r in hard_rows()] + [(100 + i, x) for i, x in enumerate(more)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3).cache()
    df.count()
    got = collections.Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in wordbpe.encode(df, path).collect())
    want = collections.Counter()
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert wordbpe.encode(empty(spark), path).count() == 0


def test_plain_letters_are_split_as_the_library_does():
    """Every code point that split() takes itself, alone and beside letters and signs."""
    t, _, _, _ = wordbpe.load(P.path("word_bpe_49k.json"))
    for c in range(1, 0xD800):
        ch = chr(c)
        if wordbpe.PLAIN.fullmatch(ch):
            for x in (ch, "a" + ch + "1", "'" + ch + "."):
                n = t.normalizer.normalize_str(x)
                assert [n[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(n)] == wordbpe.WORD.findall(x.replace("Σ", "σ").lower()), hex(c)


def test_words_of_odd_letters_equal_the_library():
    """Random strings of marks that change places, letters newer than the tables at hand, jamo, special tokens, separators."""
    path, rng = P.path("word_bpe_49k.json"), random.Random(3)
    t, words, names, special = wordbpe.load(path)
    pool = [chr(c) for c in (0x130, 0x337, 0x323, 0x307, 0x345, 0x301, 0x3A3, 0x3C2, 0x1E9E, 0x2028, 0x85, 0xA0, 0x1C, 0x1F, 0xB, 0x200D, 0x1F44D, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x3099, 0x304B, *range(0x898, 0x8CD), *range(0x300, 0x370))]
    pool += [*"abz' <|>19.\n\tsS", "<|endoftext|>", "<|startoftext|>", "'s"]
    for _ in range(20_000):
        x = "".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)))) for _ in range(rng.randrange(1, 14)))
        want = t.encode(x, add_special_tokens=False).ids
        got = [i for w in wordbpe.split(x, t, special) for i in words.encode(w, add_special_tokens=False).ids]
        assert got == want and " ".join(names[i] for i in got) == t.decode(want, skip_special_tokens=False), ascii(x)


def test_packing_long_runs_of_blanks(spark):
    """Texts that the fast encoder's pattern gives up on are encoded by the library."""
    path, texts = P.path("byte_bpe_50k.json"), [" " * 1_000_000, "\n" * 1_500_000 + "x", "y <|endoftext|>" + "\t" * 1_000_000]
    t = Tokenizer.from_file(path)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).collect()
    for k, x in enumerate(texts):
        ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def test_registered_queries():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


#: The columns that the contracts name.
CONTRACT = {
    "op1": "vec_id n_links component_id kept", "op2": "doc_id n_shingles component_id kept", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id held_out score predicted", "op5": "page_id payload_bytes payload_digest record_type refers_to", "op6": "doc_id n_words n_removed kept_sha256",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id piece start length ids_crc32 sequence_id offset", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id n_bytes n_removed n_spans kept_sha256", "op12": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_query_on_hard_tables(spark, tmp_path_factory, name):
    """Every query on tables with nulls, blank and long texts and repeated rows: its columns, a row for each row (a
    piece for operator 9), and folds by the id's checksum."""
    d = tmp_path_factory.mktemp("hard")
    hard(spark).write.parquet(str(d / "documents.parquet"))
    vectors = [(i, [float(i % 3), 1.0]) for i in range(9)] + [(20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(d / "embeddings.parquet"))
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(str(d / "pages.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(18)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    df = queries.QUERIES[name](spark, str(d))
    number = name.split("_")[0]
    assert df.columns[: len(CONTRACT[number].split())] == CONTRACT[number].split()
    rows = df.collect()
    want = {"op1": len(vectors), "op5": len(pages()), "op12": 600 * len({r[3] or "" for r in hard_rows()})}.get(number, len(hard_rows()))
    assert len(rows) == want if number != "op9" else sum(r["piece"] == 0 for r in rows) == want
    if "held_out" in df.columns:
        of, rest = (5, 1) if number == "op3" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % of == rest) for r in rows)

"""The pipeline against plain versions of its stages."""

import collections

import numpy as np
import pytest

from cytomill.llm import bytecnn, packing

from .fixtures import hard_rows, prose
from .test_duplicates import closure, kept_words, shingles
from .test_learned import base_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rows = [(*r[:5], "x") for r in hard_rows()]
    passage = prose(900, 55)
    for i in range(60):
        t = prose(100 + i, 80 + i)
        rows.append((1000 + i, t, "en" if i % 2 else "fr", "s", len(t), None))
        if i % 4 == 0:
            rows.append((2000 + i, t + " end", "en", "s", len(t) + 4, None))
        if i % 5 == 0:
            rows.append((3000 + i, prose(500 + i, 70) + " " + passage + " " + prose(600 + i, 30), "en", "s", 0, None))
        if i % 6 == 0:
            rows.append((4000 + i, "same line here\n" * 30, "fr", "s", 0, None))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def plain_language(rows):
    """Window by window, without batches."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    net = bytecnn.train(spark.createDataFrame([(r["text"], r["lang"]) for r in rows], "text string, lang string"))
    out = []
    for r in rows:
        raw = (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        total = np.zeros(len(net.languages))
        for i in range(0, len(raw), bytecnn.WINDOW):
            part = raw[i : i + bytecnn.WINDOW]
            x = np.frombuffer(part.ljust(bytecnn.WINDOW, b"\0"), np.uint8)[None]
            z = (np.maximum(net.pooled(x)[0] + net.bias, 0) @ net.out + net.out_bias)[0]
            total += len(part) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        if (p / p.sum()).max() >= corpus_pipeline.LEAST_LANGUAGE:
            out.append(r)
    return out


def plain_rules(rows):
    """Too few labels to certify a cutoff, so the base rules alone decide."""
    kept = []
    for r in rows:
        n, _, _, _, repeated = base_counts(r["text"])
        if not (n < 50 or 100 * repeated > 50 * n):
            kept.append(r)
    return kept


def plain_duplicates(rows):
    sets = [shingles(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.PERCENT * len(sets[i] | sets[j])]
    comp, best = closure(len(rows), links), {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if comp[i] not in best or key < best[comp[i]][0]:
            best[comp[i]] = (key, r)
    return [r for _, r in best.values()]


def plain_repeats(rows):
    out = []
    for r, (n, gone, text, _) in zip(rows, kept_words([(r["doc_id"], r["text"]) for r in rows], 35), strict=True):
        if gone < n:
            out.append({**r, "text": text if gone else r["text"], "n_chars": len(text if gone else r["text"])})
    return out


def counted(rows):
    return collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


def test_stages_equal_their_plain_versions(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "minmax_dedup", "substring_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_language, plain_rules, plain_duplicates, plain_repeats), strict=False):
        got = stage(spark, docs, sf_dir)
        assert got.columns == list(corpus_pipeline.COLUMNS), name
        want = plain([r.asDict() for r in docs.select(*corpus_pipeline.COLUMNS).collect()])
        docs = corpus_pipeline.store.cut(got)
        assert counted(docs.collect()) == counted(want) and 0 < len(want), name
    path = P.path("byte_bpe_50k.json")
    total = sum(len(packing.token_ids(r["text"], path)) + 1 for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in last) == total
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == collections.Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in last)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_keeps_a_row_of_each_group(spark):
    """Different texts without an id, or under one id, are different documents."""
    def row(key, text, lang="en"):
        return (key, text, lang, "s", len(text))

    a, b, c, d, e = (prose(700 + i, 80) for i in range(5))
    rows = [row(None, a), row(None, a, "fr"), row(None, b), row(7, c), row(7, d), row(8, d), row(5, e), row(None, e), row(5, e)]
    rows += [row(7, "  "), row(None, "")]
    docs = spark.createDataFrame(rows, SCHEMA.rpartition(",")[0]).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [(None, a), (None, b), (7, c), (7, d), (5, e), (7, "  "), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_dedup_links_from_eighty_per_cent(spark):
    """Jaccard similarities of five-word shingles in [0.80, 0.85) link, those below 0.80 do not."""
    rows, want = [], set()
    for i in range(40):
        words = prose(800 + i, 200).split()
        own = shingles(" ".join(words))
        for n in range(1, 60):  # the first change at the end that brings the similarity into the band
            other = [*words[:-n], *(f"x{j}" for j in range(n))]
            like = shingles(" ".join(other))
            share = 100 * len(own & like) / len(own | like)
            if share < (85 if i % 2 else 80):
                break
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(other), "en", "s", 0)]
        assert 80 <= share < 85 if i % 2 else 75 < share < 80
        want |= {2 * i} if i % 2 else {2 * i, 2 * i + 1}
    docs = spark.createDataFrame(rows, SCHEMA.rpartition(",")[0]).repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want

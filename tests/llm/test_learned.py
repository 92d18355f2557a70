"""Quality rules, line CRF, language network, context mixing: exact parts against brute force, learned parts by held-out accuracy."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytomill.llm import bytecnn, crf, mixing, queries, risk

from .fixtures import empty, hard, hard_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(wins)
    covered = {j for i, w in enumerate(wins) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_base_counts(spark):
    rows = [r[:2] for r in hard_rows()] + [(50, "a b c a b c x a b c"), (51, " ".join(random.Random(1).choice("abc") for _ in range(3000))), (52, "a a a a"), (53, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in risk.statistics(df).select("doc_id", *risk.BASE).collect())
    assert got == Counter((k, *base_counts(t)) for k, t in rows)


def test_rules_bound_is_exact(spark):
    from fractions import Fraction

    for n, k in ((500, 0), (2000, 3), (1500, 2), (4000, 9), (100, 1)):
        a = Fraction(1, 400)
        want = float(sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))) if k < n * a else 1.0
        got = spark.range(1).select(risk.lower_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 1 / 400)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def rule_tables(spark, tmp_path, n=3000):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = prose(i % 500, 60, 300).replace(" ", "### ") if bad else prose(i % 500, 60, 300)
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 0 if bad else 1, 0))
    docs += [r[:5] for r in hard_rows() if r[0] is None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))


def test_rules_query_equals_its_sql(spark, tmp_path):
    rule_tables(spark, tmp_path)
    df = queries.op7_risk_controlled_rules(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.ORACLES['op7_risk_controlled_rules']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert Counter(got) == Counter(want)
    kept = {r[0]: r[-1] for r in got}
    assert not any(kept[i] for i in range(0, 3000, 5)) and np.mean([kept[i] for i in range(3000) if i % 5]) > 0.98
    assert any(not r[-1] and not r[-2] for r in got)  # the base rules alone would not give this


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_rules_are_certified_on_a_tenth(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    stats = risk.statistics(docs.select("doc_id", "text")).drop("text").cache()
    clean = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    found = {r["stratum"]: r for r in risk.cutoffs(stats.join(clean, "doc_id", "left_semi")).collect()}
    assert found and all(r["n"] >= 408 for r in found.values())
    judged = risk.apply(stats, risk.cutoffs(stats.join(clean, "doc_id", "left_semi")))
    assert judged.where("NOT kept AND NOT base_failed").count() > 0
    rejected = judged.join(clean, "doc_id", "left_semi").where("NOT base_failed").groupBy("stratum").agg(F.mean((~F.col("kept")).cast("double"))).collect()
    assert all(share < risk.FALSE_REJECTION for _, share in rejected)


def test_rules_sequence_ends_at_the_first_failure(spark):
    """Settings: the second fails though the third, counted alone, would pass as well as the first."""
    def rows(n, value):
        return [(0, value, 0.0, 0.0, 0.0)] * n

    some = spark.createDataFrame(rows(600, 0.0) + rows(30, 1.5), "stratum int, symbols_per_word double, dup_line_share double, repeat_share double, capital_share double")
    found = risk.cutoffs(some).collect()  # the other strata have no clean documents and are merged with this one
    assert sorted(r["stratum"] for r in found) == [0, 1, 2]
    assert {(r["n"], r["setting"], r["max_symbols_per_word"], r["max_capital_share"]) for r in found} == {(630, 0, 2.0, 0.9)}
    assert risk.cutoffs(some.limit(298)).count() == 0 and risk.cutoffs(some.where("symbols_per_word = 0")).first()["setting"] == risk.SETTINGS - 1
    assert all(len(c) == risk.SETTINGS for c in risk.CUTOFFS.values())


@pytest.mark.parametrize("sizes, groups", [((408, 408, 408), [0, 1, 2]), ((407, 408, 408), [0, 0, 1]), ((368, 360, 8), [0, 1, 1]), ((300, 10, 10), [0, 0, 0]), ((100, 100, 98), None)])
def test_rules_merge_strata_until_each_has_enough(spark, sizes, groups):
    rows = [(s, 0.0, 0.0, 0.0, 0.0) for s, n in enumerate(sizes) for _ in range(n)]
    found = risk.cutoffs(spark.createDataFrame(rows, "stratum int, symbols_per_word double, dup_line_share double, repeat_share double, capital_share double")).collect()
    if groups is None:
        assert not found
    else:
        assert {r["stratum"]: r["n"] for r in found} == {s: sum(n for n, g in zip(sizes, groups, strict=True) if g == groups[s]) for s in range(3)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_rules_use_their_cutoffs_on_few_labels(spark):
    assert queries.op7_risk_controlled_rules(spark, "/root/testdata/sf0.01").where("NOT kept AND NOT base_failed").count() > 0


def test_rules_clashing_names(spark):
    names = ["_t", "_w", "_l", "_own", "_found", "_stratum", "max_repeat_share", "kept", "stratum", "a.b"]
    df = hard(spark).select("doc_id", "text", *[F.lit(f"x{c}").alias(c) for c in names])
    got = risk.judge(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert got.count() == len(hard_rows()) and {r["_t"] for r in got.collect()} == {"x_t"} and got.columns.count("kept") == 1


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in risk.judge(hard(spark), none).collect()}
    assert got[5] and not got[1] and not got[12]
    assert risk.judge(empty(spark), none).count() == 0


def language_rows():
    rng = random.Random(2)
    kinds = {"aa": "abcde fgh", "bb": "xyzwv éu", "cc": "qrst lmno"}
    out = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        out.append((i, "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(30, 700))) + "a", lang))
    return out


def test_language_held_out(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    net = bytecnn.train(df.where(queries.fold(4) != 2))
    got = bytecnn.identify(df.where(queries.fold(4) == 2), net).collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_hard_rows(spark):
    net = bytecnn.train(hard(spark))
    got = bytecnn.identify(hard(spark), net).collect()
    assert len(got) == len(hard_rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in net.languages and 0 < r["score"] <= 1) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert bytecnn.train(empty(spark)) is None and bytecnn.identify(hard(spark), None).where("lang_pred <> 'und'").count() == 0
    assert bytecnn.identify(empty(spark), net).count() == 0


def test_network_sees_all_windows():
    net = bytecnn.ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (300, bytecnn.WINDOW)).astype(np.uint8)
    net.fit(x, np.arange(300) % 2, epochs=1)
    assert np.allclose(net.features(x), net.pooled(x)[0])
    data = np.arange(1000).astype(np.uint8)
    start, row, length = bytecnn.layout(np.array([0, 0, 700, 1000]))
    assert sorted(np.concatenate([np.arange(s, s + n) for s, n in zip(start, length, strict=True)])) == list(range(1000)) and set(row) == {1, 2}
    assert (bytecnn.gather(data, start, length)[-1][length[-1] :] == 0).all()


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    c = crf.LineCRF(np.zeros(crf.FEATURES), rng.normal(size=(2, 2)))
    n = np.array([1, 4, 6, 2])
    u = rng.normal(size=n.sum()) * 2
    first = np.cumsum(n) - n
    p, xi = c.marginals(u, first, n, pairs=True)
    total = np.zeros((2, 2))
    for f, k in zip(first, n, strict=True):
        weight = np.zeros(k)
        pair, z = np.zeros((2, 2)), 0.0
        for code in range(1 << k):
            y = [(code >> i) & 1 for i in range(k)]
            s = math.exp(sum(u[f + i] * y[i] for i in range(k)) + sum(c.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += s
            weight += s * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pair[a, b] += s
        assert np.allclose(p[f : f + k], weight / z)
        total += pair / z
    assert np.allclose(xi, total)


def test_crf_held_out(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        good = i % 3 > 0
        lines = [prose(rng.randint(0, 10**6), rng.randint(4, 12)).capitalize() + "." for _ in range(rng.randint(2, 8))]
        rows.append((i, "\n".join(x if good else x.upper().replace(" ", "!! ") for x in lines), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = crf.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), queries.fold(4) != 2)
    got = crf.score(df.where(queries.fold(4) == 2), model).collect()
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in got]) > 0.95


def test_crf_hard_rows(spark):
    labels = spark.createDataFrame([(5, 1), (9, 1), (12, 0), (13, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = crf.train(hard(spark), labels, F.lit(True))
    got = crf.score(hard(spark), model).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if not (r["text"] or "").strip())
    assert crf.train(hard(spark), labels.limit(0), F.lit(True)) is None
    assert crf.score(empty(spark), model).count() == 0 and crf.score(hard(spark), None).where("score = 0.5").count() == len(hard_rows())


def test_crf_sample_is_bounded_and_has_whole_texts(spark):
    """An id with many rows and a very long text count as one document; the long text reaches the fit whole."""
    long = "".join(f"line {i} of it\n" for i in range(40_000))
    rows = [(1, long)] + [(2, f"text {i}") for i in range(500)] + [(i, f"word {i}") for i in range(3, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = crf.sampled(df, labels, F.lit(True))
    assert len(got) == 39 and len(crf.sampled(df, labels, F.lit(True), sample=10)) <= 10
    assert [t for _, _, t in got if len(t) > 1000] == [long]


def test_crf_fit_sees_every_line():
    """Good and bad texts that differ in one line only, wherever it stands in long texts, are told apart."""
    plain = [f"a line of some words, number {i % 7}.\n" for i in range(2000)]
    texts, good = [], []
    for i in range(24):
        at = i * 80
        texts.append("".join([*plain[:at], "$$$ ### !!! &&&\n" * 60, *plain[at:]]) if i % 2 else "".join(plain))
        good.append(1 - i % 2)
    model = crf.fit(texts, np.array(good))
    x, row, weight = crf.lines(*crf.buffer_of(pa.array(texts, pa.large_string())))
    score = model.score(*model.documents(x, row, weight, len(texts)))
    assert max(score[1::2]) < min(score[::2])


def plain_crf_score(model, text):
    """Features line by line, marginals by enumeration, the mean and the curve, without batches."""
    x, row, weight = crf.lines(*crf.buffer_of(pa.array([text], pa.large_string())))
    if not len(x):
        return 0.0
    n, u = len(x), np.clip(x @ model.w, -30, 30)
    good, z = np.zeros(n), 0.0
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        s = math.exp(sum(u[i] * y[i] for i in range(n)) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        z, good = z + s, good + s * np.array(y)
    size = [len("".join(line.split()).encode()) for line in text.split("\n") if line.strip()]
    m = min(max(float((good / z) @ np.array(size)) / sum(size), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log(m / (1 - m)))))


def test_crf_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, "\n".join(prose(rng.randint(0, 9999), rng.randint(1, 9)).capitalize() + rng.choice([".", "!!", " 12", ""]) for _ in range(rng.randint(1, 7)))) for i in range(80)]
    docs += [(100, ""), (101, None), (102, " \n ")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int("!!" not in (t or ""))) for i, t in docs[:70]], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_line_crf_quality(spark, str(tmp_path)).collect()}
    model = crf.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, queries.fold(4) != 2)
    for i, t in docs:
        r = got[i]
        assert r["score"] == pytest.approx(plain_crf_score(model, t or ""), abs=1e-6) and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def reference_scores(rows):
    low = {i: i + 32 for i in range(65, 91)}
    tokens = {i: [*WORD.findall((t or "").translate(low)), None] for i, (_, t) in enumerate(rows)}
    c = Counter()
    for i, (k, _) in enumerate(rows):
        if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1:
            c.update(tokens[i])
    n, v = sum(c.values()), len(c)
    return [(k, len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens[i])) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_mixing_base_scores(spark, block):
    rows = [r[:2] for r in hard_rows()] + [(100 + i, prose(i % 7, 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3).cache()
    df.count()
    got = mixing.score(df, queries.fold(5) != 1, block=block).collect()
    want = sorted(reference_scores(rows), key=str)
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert np.allclose([h[4] for h in have], [w[4] for w in want])
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def local_scores(train, texts, buckets=3):
    """The parts of the operator on two blocks, the training texts and the others, without Spark."""
    (counted,) = list(mixing._count(iter([pa.RecordBatch.from_arrays([pa.array(train, pa.string())], names=["text"])])))
    model = mixing.model_of(counted.column(0).to_numpy(), counted.column(1).to_numpy())
    made = []
    for part, learn in ((train, True), (texts, False)):
        st = mixing.Stretches(*mixing.buffer_of(pa.array(part, pa.large_string())))
        asked = mixing.Asked(st, buckets, model.bits)
        asked.count(st, np.full(len(part), learn))
        made.append((st, asked, [asked.row(b) for b in range(buckets)]))
    counts = [mixing.Counts([m[2][b] for m in made], b, buckets) for b in range(buckets)]
    return model, [mixing.scores(model, st, asked, mixing.Answers([counts[b].answer(rows[b]) for b in range(buckets)], asked)) + model.ends(st) for st, asked, rows in made]


def plain_scores(train, texts):
    """Counts in dictionaries, decisions one by one; alphabets and codes as the operator has them, which other tests hold."""
    cut = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+")

    def walk(text):
        raw = text.encode()
        data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        found = [m.group() for m in cut.finditer(raw)]
        begin = np.cumsum([0, *map(len, found)])[:-1]
        signs = mixing.alphabets(data, offs, begin).tolist() if found else []
        two, one = 2, 1
        for x, sign in zip(found, signs, strict=True):
            yield x, sign, (two, one)
            two, one = one, x.strip(b" \t\n\v\f\r").lower()

    triple, after, follow = Counter(), {}, {}
    for t in train:
        for x, sign, pair in walk(t):
            y = b"\0\0" + x
            for i in range(len(x)):
                triple[y[i : i + 3]] += 1
                after.setdefault((sign, x[:i]), Counter())[x[i]] += 1
            follow.setdefault(pair, Counter())[x[:16].ljust(16, b"\0")] += 1
    pairs = np.zeros((256, 256), np.int64)
    for k, c in triple.items():
        pairs[k[1], k[2]] += c
    code = mixing.huffman(pairs)

    def path(one, b):
        k = one * 256 + b
        at = slice(code.first[k], code.first[k] + code.length[k])
        return list(zip(code.node[at].tolist(), code.bit[at].tolist(), strict=True))

    def logit(count, one, node):
        n = [0, 0]
        for b, c in count.items():
            for k, v in path(one, b):
                n[v] += c * (k == node)
        x = min(max(math.log((n[1] + mixing.DELTA) / (n[0] + mixing.DELTA)), -mixing.CLIP), mixing.CLIP)
        return round(x * mixing.SCALE) / mixing.SCALE if any(n) else 0.0

    by_one, by_two = {}, {}
    for k, c in triple.items():
        by_one.setdefault(k[1], Counter())[k[2]] += c
        by_two.setdefault(k[:2], Counter())[k[2]] += c
    out = []
    for t in texts:
        w, level, total = mixing.START.astype(float).copy(), Counter(), 0.0
        for x, sign, pair in walk(t):
            seen = follow.get(pair)
            guess, size, gate = b"", 0.0, 0
            if seen:
                guess, best = min(seen.items(), key=lambda kv: (-kv[1], int.from_bytes(kv[0][:8], "little"), int.from_bytes(kv[0][8:], "little")))
                n = sum(seen.values())
                size = round(min(max(math.log((best + mixing.DELTA) / (n - best + mixing.DELTA)), 0), mixing.CLIP) * mixing.SCALE) / mixing.SCALE
                gate = 1 if 2 * best <= n else 2 if best < 2 else 3
            agree, step, change, y = True, np.zeros(5), Counter(), b"\0\0" + x
            for i in range(len(x)):
                one = y[i + 1]
                want = path(one, guess[i]) if agree and i < len(guess) and guess[i] else []
                for d, (node, bit) in enumerate(path(one, x[i])):
                    s = 2 * bit - 1
                    a = 0.0
                    if agree and d < len(want) and want[d][0] == node:
                        a = size * (2 * want[d][1] - 1)
                        agree = want[d][1] == bit
                    c = logit(after.get((sign, x[:i]), {}), one, node)
                    v = np.array([logit(by_one.get(one, {}), one, node), logit(by_two.get(y[i : i + 2], {}), one, node), c, a, c * abs(c) / mixing.CLIP])
                    z = min(max(float(v @ w[gate]), -11.9), 11.9)
                    spot = round(z * (mixing.LEVELS - 1) / 24)
                    miss = 1 / (1 + math.exp(s * (z + level[spot])))
                    total += math.log10(1 - miss)
                    step += v * s * miss
                    change[spot] += s * miss * mixing.REFINE
                agree = agree and bool(want)
            w[gate] += mixing.RATE * step
            level.update(change)
        out.append(total)
    return np.array(out)


def test_mixing_equals_a_plain_version():
    rng = random.Random(4)
    train = [prose(i % 4, 40, 60) + rng.choice([".", "\n\n é ü", " ", ""]) for i in range(12)] + ["", "naïve Æther ж и", "averyveryverylongwordbeyond16bytes again", "averyveryverylongwordbeyond16letters again"]
    texts = [train[0], train[12], prose(1, 30, 60) + " " + prose(77, 20), "Zz \t q", "", "日本 averyveryverylongwordbeyond16bytes", train[3][:80] + "x" + train[3][80:]]
    model, (own, other) = local_scores(train, texts)
    for got, part in ((own, train), (other, texts)):
        st = mixing.Stretches(*mixing.buffer_of(pa.array(part, pa.large_string())))
        assert np.allclose(got - model.ends(st), plain_scores(train, part), rtol=1e-3, atol=1e-3)


def test_mixing_learns_and_does_not_depend_on_the_batch():
    texts = [prose(i % 5, 200, 60) for i in range(60)]
    strange = "".join(random.Random(1).choice("abcdefghij") for _ in range(1000))
    part = [*texts[50:], "", "é", strange, " ", "x\n\ny"]
    _, (_, whole) = local_scores(texts[:50], part)
    single = np.array([local_scores(texts[:50], [t])[1][1][0] for t in part])
    assert np.allclose(whole, single, rtol=1e-4)
    assert -whole[0] / len(texts[50]) < -whole[-3] / len(strange)


def test_mixing_tells_copies_apart():
    """A held-out text whose copy was learned costs far less than one whose words alone are known."""
    texts = [prose(i, 150, 40) for i in range(30)]
    shuffled = [" ".join(random.Random(i).sample(t.split(), 150)) for i, t in enumerate(texts)]
    _, (_, got) = local_scores(texts, [*texts, *shuffled])
    assert (-got[:30]).max() < 0.5 * (-got[30:]).min()


def test_mixing_codes_are_complete():
    code = mixing.huffman(np.random.default_rng(0).integers(0, 1000, (256, 256)))
    for one in (0, 7, 255):
        assert sum(2.0 ** -int(n) for n in code.length[one * 256 : one * 256 + 256]) == pytest.approx(1)
    assert int(code.node.max()) == 254


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_beats_its_base_on_held_out_texts(spark, sf):
    docs = queries.table(spark, f"/root/testdata/{sf}", "documents")
    got = queries.op3_context_mixing(spark, f"/root/testdata/{sf}").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == docs.count() and len(got) == 2
    assert all(r["s"] > r["b"] for r in got)


def test_mixing_empty(spark):
    assert mixing.score(empty(spark), F.lit(True)).count() == 0


def test_language_sample_counts_copies_once_and_holds_every_language(spark):
    copies = [(prose(1, 100), "en")] * 400
    rows = [*copies, *((prose(10 + i, 60), "en") for i in range(300)), *((prose(900 + i, 60), "fr") for i in range(3))]
    df = spark.createDataFrame([*rows, (None, "en"), ("no language", None), ("12 34", "en")], "text string, lang string").repartition(3)
    got = bytecnn.sampled(df, sample=20)
    assert Counter(lang for _, lang, _ in got) == {"en": 17, "fr": 3}
    assert len({h for h, _, _ in got}) == 20 and {t for _, lang, t in got if lang == "fr"} == {t for t, lang in rows if lang == "fr"}
    assert bytecnn.train(df, sample=20).languages == ["en", "fr"]
    assert bytecnn.quota([5, 100, 100], 25) == 10 and bytecnn.quota([1] * 9, 4) == 1


def test_language_sample_has_whole_texts_and_bounded_languages(spark):
    long = "a" * 30_000 + "é" * 30_000 + "z" * 300
    assert [t for _, _, t in bytecnn.sampled(spark.createDataFrame([(long, "en")], "text string, lang string"))] == [long]
    rows = [(f"text {i}", f"l{i}") for i in range(30)] + [(f"words {i}", "l3") for i in range(5)] + [("other", "l20")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert Counter(lang for _, lang, _ in bytecnn.sampled(df, sample=6, languages=3)) == {"l3": 3, "l20": 2, "l0": 1}
    assert len(bytecnn.sampled(df, sample=2)) == 30  # one of each language at least


def test_mixing_continuations_and_end_sum_to_one():
    """Over all 256 bytes and the end, behind texts with and without alphabets, known and unknown words."""
    train = [prose(i, 60, 30) + " é à è ж" for i in range(10)]
    for prefix in ("", "a", "é à è ", "ж word жжж", "x " * 300, train[0][:90], " ".join(train[1].split()[:9]) + " "):
        raw = prefix.encode()
        data = b"".join([raw, *(raw + bytes([b]) for b in range(256))])
        offs = np.cumsum([0, len(raw), *[len(raw) + 1] * 256])
        (counted,) = list(mixing._count(iter([pa.RecordBatch.from_arrays([pa.array(train, pa.string())], names=["text"])])))
        model = mixing.model_of(counted.column(0).to_numpy(), counted.column(1).to_numpy())
        learned = mixing.Stretches(*mixing.buffer_of(pa.array(train, pa.large_string())))
        first, s = mixing.Asked(learned, 1, model.bits), mixing.Stretches(np.frombuffer(data, np.uint8), offs)
        first.count(learned, np.ones(len(train), bool))
        asked = mixing.Asked(s, 1, model.bits)
        asked.count(s, np.zeros(257, bool))
        counts = mixing.Counts([first.row(0), asked.row(0)], 0, 1)
        bytes_, ends = mixing.scores(model, s, asked, mixing.Answers([counts.answer(asked.row(0))], asked)), model.ends(s)
        stop = model.stop[raw[-1] if raw else 256]
        goes_on = ends[0] - np.log10(stop) + np.log10(1 - stop)
        share = 10 ** (bytes_[1:] - bytes_[0])
        # the last stretch grows by the byte, or a new one begins behind white space: its weights are those of the bytes before
        assert share.sum() == pytest.approx(1, abs=2e-3)
        assert stop + (10 ** (goes_on - (ends[0] - np.log10(stop))) * share).sum() == pytest.approx(1, abs=2e-3)
        assert np.allclose(ends[1:], goes_on + np.log10(model.stop[:256]))


def test_mixing_alphabet_is_that_of_the_bytes_before():
    texts = ["plain words é é ñ ñ ñ end", "é", "no more", "", "ж и"]
    data, offs = mixing.buffer_of(pa.array(texts, pa.large_string()))
    begin = mixing.Stretches(data, offs).begin
    want = []
    for b in begin:
        text = max(i for i in range(len(texts)) if offs[i] <= b < offs[i + 1])
        count, best = Counter(), 0
        for x in data[offs[text] : b].tolist():
            if 0x80 <= x < 0xC0:
                count[x] += 1
                best = x - 0x7F if count[x] == max(count.values()) else best
        want.append(best if max(count.values(), default=0) * 500 > b - offs[text] else 0)
    assert mixing.alphabets(data, offs, begin).tolist() == want and len(set(want)) > 2


def test_mixing_score_charges_the_end(spark):
    rows = [(i, prose(i % 5, 20)) for i in range(20)] + [(20, ""), (21, None)]
    got = {r["doc_id"]: r["score"] for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert got[20] == got[21] == pytest.approx(math.log10(2.5 / 23))


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_mixing_compiled_loops_equal_the_numpy_steps(spark, block):
    """The query's loops run in the executors' JVM; every column equals that of the steps in numpy, which a plain version holds."""
    rows = [r[:2] for r in hard_rows()] + [(100 + i, prose(i % 7, 50) + " é à ж 日本\0\n" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    df.count()
    got, want = (sorted((tuple(r) for r in mixing.score(df, queries.fold(5) != 1, block=block, compiled=c).collect()), key=str) for c in (True, False))
    assert [g[:5] for g in got] == [w[:5] for w in want] and len(got) == len(rows)
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-5)


def test_mixing_query_scores_in_compiled_loops(spark):
    """Python workers pass blocks on and sum counts; asking and scoring stay out of them."""
    from unittest import mock

    df = spark.createDataFrame([(i, prose(i % 5, 20)) for i in range(20)], "doc_id long, text string")
    with mock.patch.object(mixing, "_ask") as ask, mock.patch.object(mixing, "_join") as join:
        assert mixing.score(df, F.lit(True)).count() == 20
    assert not ask.called and not join.called


def test_mixing_query_sums_in_compiled_loops(spark):
    """Blocks' counts are summed and answered in the executors' JVM, not in Python workers."""
    from unittest import mock

    df = spark.createDataFrame([(i, prose(i % 5, 20)) for i in range(20)], "doc_id long, text string")
    with mock.patch.object(mixing, "_tally") as tally:
        assert mixing.score(df, F.lit(True), block=200).count() == 20
    assert not tally.called


def test_mixing_compiled_sums_equal_the_numpy_steps(spark):
    """Byte for byte what the buckets answer in numpy: hot prefixes, ties between stretches, words above 16 bytes, zeros, texts that none has learned."""
    rows = [r[:2] for r in hard_rows()] + [(100 + i, prose(i % 7, 50) + " é à ж 日本\0\n" * (i % 3)) for i in range(60)] + [(200 + i, f"a b {'xy'[i % 2]}\0 averyveryverylongwordbeyond{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    slim = df.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), (queries.fold(5) != 1).alias("learn"), F.spark_partition_id().alias("part"))
    for buckets in (1, 3):
        asked = slim.mapInArrow(mixing._ask(buckets, 2000, 40), mixing.ASKED).cache()
        got, want = mixing._answered(asked, buckets), mixing.blocks.by_bucket(asked, buckets).mapInArrow(mixing._tally(buckets), mixing.ANSWERED)
        got, want = ({(r["block"], r["bucket"], r["sum"]): [a.tolist() for a in mixing.unpacked(bytes(r["data"]))] for r in d.collect()} for d in (got, want))
        assert got == want and len(got) > 2 * buckets
    assert not mixing._answered(asked.limit(0), 3).count()


@pytest.mark.parametrize("options", ["-Xshare:off", "-XX:+UseSerialGC"])
def test_mixing_in_a_fresh_jvm(options, tmp_path):
    """The compiled functions do not depend on the order in which a JVM lists overloads."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.driver.extraJavaOptions", "{options}").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from cytomill.llm import mixing
print("rows", mixing.score(spark.createDataFrame([(1, "a b"), (2, "b a")], "doc_id long, text string"), F.lit(True)).count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")})
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_mixing_functions_are_chosen_by_the_compiler():
    """No call from Python reaches an overload of udf that takes any object."""
    import inspect

    from cytomill.llm import jvm

    assert "functions.udf" not in inspect.getsource(jvm.function)

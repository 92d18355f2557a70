"""The registered queries ``opN_<name>``: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import risk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % of


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bytecnn

    docs = table(spark, sf_dir, "documents")
    net = bytecnn.train(docs.where(fold(4) != 2).select("text", "lang"))
    found = bytecnn.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op1_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lattice

    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minmax

    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.score(table(spark, sf_dir, "documents"), fold(5) != 1)


def op4_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import crf

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf.train(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    found = crf.score(docs, model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from . import store, warc

    out = f"{store.shared_dir(spark)}/cytomill/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *risk.BASE, "base_failed", "kept")


def op9_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import wordbpe

    found = wordbpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_hash_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    found = suffixes.remove_earlier(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    found = audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.where("NOT is_total").drop("is_total")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the ids with a checksum divisible by ten have the periodic tail that the contract gives them."""
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n, h = F.size(w), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    words = F.slice(F.concat(F.slice(w, F.lit(1), a), tail), F.lit(1), n)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.coalesce(n > 0, F.lit(False)), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_bit_parallel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    found = periodic.find_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = (F.sha2(F.encode(x, "UTF-8"), 256).alias(name) for x, name in ((lines, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256")))
    return found.select("doc_id", *periodic.ADDED[:5], *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_near_duplicates, op2_minmax_near_duplicates, op3_context_mixing, op4_line_crf_quality, op5_sharded_warc,
        op6_seed_and_extend, op7_risk_controlled_rules, op8_byte_cnn_language, op9_vector_best_fit, op10_word_table_bpe,
        op11_hash_suffix_sort, op12_filter_interactions, op13_bit_parallel_runs,
    )
}
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT *, encode(html) AS raw, sha1(html) AS hex FROM p),
d AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT // (1::BIGINT << (35 - 5 * (i % 8))) % 32)::INT, 1), '' ORDER BY i) FROM range(32) r(i)) AS digest FROM b)
SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER (PARTITION BY html) THEN max(page_id) OVER (PARTITION BY html) END AS refers_to FROM d
"""
_REACH = """reach(id, r) AS (SELECT DISTINCT id, id FROM node UNION SELECT l.b, reach.r FROM reach JOIN link l ON l.a = reach.id)"""
OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95), node AS (SELECT vec_id AS id FROM embeddings), {_REACH},
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.a = vec_id
"""
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (n - i)), node AS (SELECT doc_id AS id FROM documents), {_REACH}, c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = doc_id
"""
OP6_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS h FROM g), d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM d, (SELECT unnest(range(35)) AS o)), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
OP11_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT *, length(x) // 2 AS n FROM d),
g AS (SELECT doc_id, unnest(range(n - 99)) AS i, x FROM n WHERE n >= 100), h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM g),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 100, true)::INT AS new FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM (FROM s UNION ALL SELECT doc_id, n, n FROM n)),
k AS (SELECT doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, b) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n - length(kept) // 2 AS n_removed, (SELECT count(*) FROM s WHERE s.doc_id = n.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN k USING (doc_id)
"""
OP12_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter([
    CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS bad
  FROM w LEFT JOIN m USING (doc_id)),
l AS (SELECT unnest(string_split('ABCDE', '')) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o), c AS (SELECT part, bad, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, filter_order[step] AS name, n, good, toxic, bad, coalesce(list_min(list_transform(bad, lambda b: strpos(filter_order, b))), 6) AS goes FROM c, s),
r AS (SELECT part, filter_order, step, name, coalesce(sum(n) FILTER (WHERE goes > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE goes = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE goes < step AND list_contains(bad, name)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE bad = [name]), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE goes = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE goes = step AND toxic), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, name)::BIGINT AS shapley FROM r
"""
#: Runs from strings of 6 words that a text has twice: q words apart, 6 equal words in a row and more.
OP13_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w,
  xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda v, x: list_reduce(list_concat([xor(v, x)], [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda u, k: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))), 4294967295::UBIGINT)::BIGINT AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM w),
t AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
s AS (SELECT doc_id, unnest(range(n - 5)) AS i, w FROM t WHERE n >= 12), m AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS m FROM s),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.m = y.m AND x.i < y.i),
e AS (SELECT doc_id, q, min(i) AS a, count(*) + 5 AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM p) GROUP BY doc_id, q, z),
r AS (SELECT doc_id, a AS start, k + q AS length, min(q) AS period FROM e WHERE k + q >= greatest(12, 2 * q) GROUP BY doc_id, a, k + q),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, list(struct_pack(l := -length, s := start, p := period) ORDER BY -length, start, period)[1] AS b FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM t),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.b.s AS start, -b.b.l AS length, b.b.p AS period, -1000 * b.b.l // b.b.p AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
ORACLES: dict[str, str] = {"op1_lattice_near_duplicates": OP1_SQL, "op2_minmax_near_duplicates": OP2_SQL, "op5_sharded_warc": OP5_SQL, "op6_seed_and_extend": OP6_SQL, "op7_risk_controlled_rules": risk.oracle(), "op11_hash_suffix_sort": OP11_SQL, "op12_filter_interactions": OP12_SQL, "op13_bit_parallel_runs": OP13_SQL}

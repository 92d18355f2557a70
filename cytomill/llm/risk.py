"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Each rule is a statistic of a text, high for bad texts. A setting gives every rule a cutoff; the settings
are a fixed sequence from lenient to strict. On the labelled clean documents of a stratum a setting is
certified when the exact binomial lower tail P(Bin(n, FALSE_REJECTION) <= k) is at most the level, k being
the clean documents that any of its rules would reject: with that confidence the rules together
reject less than FALSE_REJECTION of the stratum's clean documents (the one-sided Clopper-Pearson bound).
Settings are tested in their order and the first failure ends the sequence (fixed-sequence testing, so the
last one certified needs no correction within a stratum); over strata the level is divided by their number
(Bonferroni). A stratum with fewer than ln(level) / ln(1 - FALSE_REJECTION) clean documents cannot certify anything,
so neighbouring strata are merged until each has as many: of all ways to cut the strata's row into stretches (GROUPINGS)
the first counts in which every stretch has them, at the level of that number of stretches (408 clean documents for each of three,
368 of two, 299 for all together). Which one depends on the numbers of clean documents alone, never on what a rule rejects,
so it needs no correction. With fewer than 299 clean documents the base rules alone decide.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Fixed cutoffs by statistic; the i-th of all statistics are the i-th setting.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "capital_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
#: Strata by number of words: the lower ends.
STRATA: tuple[int, ...] = (0, 150, 600)
FALSE_REJECTION, LEVEL = 0.01, 0.05
#: The stretch of each stratum in every way to merge neighbours, those with most stretches first.
GROUPINGS: tuple[tuple[int, ...], ...] = tuple(sorted((tuple(sum(cuts[:i]) for i in range(len(STRATA))) for cuts in product((0, 1), repeat=len(STRATA) - 1)), key=lambda g: (-g[-1], g)))
SETTINGS = 8
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at the ascending ``positions``."""
    steps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of BASE (long), the rules' statistics (double) and ``stratum`` (int).

    A null text counts as empty; all its counts and statistics are 0. One scan without a shuffle:
    every count stays inside its row. Columns of those names in ``docs`` are replaced; further columns
    may have any name, as they are kept aside in one column meanwhile.
    """
    own = [c for c in docs.columns if c not in {*BASE, *CUTOFFS, "stratum"}]
    d = docs.select((F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(0)).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumns({
        "_w": F.filter(F.split("_t", WHITE), lambda w: w != ""),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }).drop("_t")
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_j": F.array_join("_w", ""),
        "_n_lines": F.size("_l"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_x": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_w", "_l")
    d = d.withColumn("_h", F.when(F.col("n_words") >= 3, F.zip_with(F.zip_with(F.slice("_x", 1, F.size("_x") - 2), F.slice("_x", 2, F.size("_x") - 2), lambda a, b: F.xxhash64(a, b)), F.slice("_x", 3, F.size("_x") - 2), lambda a, b: F.coalesce(F.xxhash64(a, b), F.lit(0)))).otherwise(F.array().cast("array<long>"))).drop("_x")
    d = d.withColumn("_s", F.sort_array("_h"))
    d = d.withColumn("_r", F.array_distinct(F.filter(F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull()))).drop("_s")
    few = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_r", h), i)), lambda i: i.isNotNull())
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.size("_r") > 64, pairs))  # many repeats: pairs of hash and place, sorted
    near = F.transform("_p", lambda p, j: F.when((F.get("_p", j - 1)["h"] == p["h"]) | (F.get("_p", j + 1)["h"] == p["h"]), p["i"]))
    d = d.withColumn("_q", F.when(F.size("_r") == 0, F.array().cast("array<int>")).when(F.size("_r") <= 64, few).otherwise(F.array_sort(F.filter(near, lambda i: i.isNotNull()))))
    d = d.withColumns({
        "n_repeat_words": covered(F.col("_q")).cast("long"),
        "word_chars": F.length("_j").cast("long"),
        "n_symbols": (F.length("_j") - F.length(F.regexp_replace("_j", SYMBOLS, ""))).cast("long"),
        "_caps": F.length("_j") - F.length(F.regexp_replace("_j", "[A-Z]+", "")),
    })

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    d = d.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "_n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "capital_share": share("_caps", "word_chars"),
        "stratum": sum((F.col("n_words") >= lo).cast("int") for lo in STRATA[1:]),
    })
    return d.select(*[F.col("_own")[c].alias(c) for c in own], *BASE, *CUTOFFS, "stratum")


def lower_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exactly summed term by term; 1 where k is not below n * alpha."""
    odds, start = math.log(alpha) - math.log1p(-alpha), n.cast("double") * math.log1p(-alpha)
    first = F.struct(start.alias("t"), F.exp(start).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.ln((n - j + 1).cast("double") / j) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.when(k < n * alpha, F.aggregate(terms, first, step, lambda acc: acc["s"])).otherwise(1.0)


def least_clean(parts: int, false_rejection: float = FALSE_REJECTION, level: float = LEVEL) -> int:
    """The fewest clean documents with which a stretch, one of ``parts``, can certify a setting: none of them rejected."""
    return math.ceil(math.log(level / parts) / math.log1p(-false_rejection))


def cutoffs(clean: DataFrame, false_rejection: float = FALSE_REJECTION, level: float = LEVEL) -> DataFrame:
    """The certified setting of each stratum from the statistics of labelled clean documents: ``stratum``, ``n``
    (clean documents of its stretch), ``setting`` and ``max_`` with each rule's name; no row where no setting is certified.
    One aggregation of conditional counts, combined before its shuffle; at most a row per stratum after it."""
    over = [F.coalesce(_any([F.col(r) > cs[i] for r, cs in CUTOFFS.items()]), F.lit(False)) for i in range(SETTINGS)]
    counts = clean.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(o.cast("long")).alias(f"k{i}") for i, o in enumerate(over)])
    has = [F.coalesce(F.sum(F.when(F.col("stratum") == s, F.col("n"))), F.lit(0)) for s in range(len(STRATA))]
    chosen = F.array(*[F.lit(g) for g in GROUPINGS[-1]])
    for grouping in reversed(GROUPINGS[:-1]):
        parts = grouping[-1] + 1
        enough = [sum(has[s] for s in range(len(STRATA)) if grouping[s] == p) >= least_clean(parts, false_rejection, level) for p in range(parts)]
        chosen = F.when(_all(enough), F.array(*[F.lit(g) for g in grouping])).otherwise(chosen)
    strata = counts.agg(chosen.alias("g")).select((F.array_max("g") + 1).alias("parts"), F.posexplode("g").alias("stratum", "part"))  # a row per stratum
    merged = counts.join(F.broadcast(strata), "stratum").groupBy("part", "parts").agg(F.sum("n").alias("n"), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(SETTINGS)])
    ok = F.array(*[lower_tail(F.col("n"), F.col(f"k{i}"), false_rejection) <= level / F.col("parts") for i in range(SETTINGS)])
    first = F.array_position(ok, False)  # of the first failure, from 1 on; 0 if there is none
    passed = F.when(first == 0, SETTINGS).otherwise(first - 1).cast("int")  # how many come before it
    best = strata.drop("parts").join(F.broadcast(merged.select("part", "n", (passed - 1).alias("setting"))), "part").where("setting >= 0").select("stratum", "n", "setting")
    return best.select("*", *[F.element_at(F.array(*map(F.lit, cs)), F.col("setting") + 1).alias(f"max_{r}") for r, cs in CUTOFFS.items()])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def apply(stats: DataFrame, found: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``. ``found`` has one row per stratum at most, so it
    is broadcast whatever the input. A value equal to its cutoff passes."""
    stats = stats.drop("base_failed", "kept")
    own, key = stats.columns, store.unused("_stratum", stats.columns)
    at = store.unused("_found", stats.columns)
    limits = found.select(F.col("stratum").alias(key), F.struct(*[f"max_{r}" for r in CUTOFFS]).alias(at))
    joined = stats.join(F.broadcast(limits), stats["stratum"] == F.col(key), "left")
    over = F.coalesce(_any([F.col(r) > F.col(at)[f"max_{r}"] for r in CUTOFFS]), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(*[F.col(f"`{c}`") for c in own], failed.alias("base_failed"), (~failed & ~over).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """The verdicts on all ``docs``: their columns, without the text unless ``keep_text``, the statistics, ``base_failed``, ``kept``.

    ``labels`` has ``key`` and ``quality``; a document is clean when all its labels are 1, rows with
    null are ignored. Strata with too few clean documents are merged with their neighbours; without enough in all of them
    the base rules alone decide. Rows without a key are judged but teach nothing. Repeated rows are judged alike
    and count as often as they come; a value equal to its cutoff passes; an empty table stays empty.
    """
    stats = statistics(docs, text)
    stats = store.cut(stats if keep_text else stats.drop(text), "stats")
    clean = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("_q")).where("_q = 1").select(key)
    return apply(stats, cutoffs(stats.join(clean, key, "left_semi")))


def oracle() -> str:
    """DuckDB SQL for the query on ``documents`` and ``labels``."""
    alpha = FALSE_REJECTION
    sums = [[" + ".join(f"s{s}" for s in range(len(STRATA)) if g[s] == p) for p in range(g[-1] + 1)] for g in GROUPINGS]
    chosen = " ".join(f"WHEN {' AND '.join(f'{x} >= {least_clean(len(xs))}' for x in xs)} THEN {list(g)}" for g, xs in zip(GROUPINGS[:-1], sums[:-1], strict=True))
    has = ", ".join(f"count(*) FILTER (WHERE stratum = {s}) AS s{s}" for s in range(len(STRATA)))

    def over(i: int) -> str:
        return " OR ".join(f"{r} > {cs[i]!r}::DOUBLE" for r, cs in CUTOFFS.items())

    tests = " UNION ALL ".join(f"SELECT part, parts, {i} AS i, count(*) AS n, count(*) FILTER (WHERE {over(i)}) AS k FROM clean JOIN strata USING (stratum) GROUP BY part, parts" for i in range(SETTINGS))
    verdict = " ".join(f"WHEN {i} THEN NOT ({over(i)})" for i in range(SETTINGS))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT r, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
p AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS i FROM h, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY r),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(j)::BIGINT AS word_chars, (length(j) - length(regexp_replace(j, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(j) - length(regexp_replace(j, '[A-Z]+', '', 'g')) AS caps
  FROM (SELECT *, array_to_string(w, '') AS j FROM w) JOIN d USING (r) LEFT JOIN p USING (r)),
stats AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE n_symbols::DOUBLE / n_words END AS symbols_per_word, CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines::DOUBLE / n_lines END AS dup_line_share,
  CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words::DOUBLE / n_words END AS repeat_share, CASE WHEN word_chars = 0 THEN 0 ELSE caps::DOUBLE / word_chars END AS capital_share,
  {" + ".join(f"(n_words >= {lo})::INT" for lo in STRATA[1:])} AS stratum FROM s),
clean AS (SELECT * FROM stats SEMI JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) c USING (doc_id)),
strata AS (SELECT unnest(range({len(STRATA)})) AS stratum, unnest(g) AS part, list_max(g) + 1 AS parts FROM (SELECT CASE {chosen} ELSE {list(GROUPINGS[-1])} END AS g FROM (SELECT {has} FROM clean))),
tests AS ({tests}),
term AS (SELECT part, parts, i, j, n * ln(1 - {alpha!r}) + sum(CASE WHEN j = 0 THEN 0 ELSE ln((n - j + 1)::DOUBLE / j) + ln({alpha!r}) - ln(1 - {alpha!r}) END) OVER (PARTITION BY part, i ORDER BY j) AS t
  FROM (SELECT *, unnest(generate_series(0, k)) AS j FROM tests WHERE k < n * {alpha!r})),
ok AS (SELECT part, i FROM term GROUP BY part, parts, i HAVING sum(exp(t)) <= {LEVEL!r}::DOUBLE / parts),
done AS (SELECT part, coalesce(min(t.i) FILTER (WHERE ok.i IS NULL), {SETTINGS}) - 1 AS setting FROM tests t LEFT JOIN ok USING (part, i) GROUP BY part),
ended AS (SELECT stratum, setting FROM strata JOIN done USING (part)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats LEFT JOIN ended USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND CASE setting {verdict} ELSE true END AS kept FROM judged
"""

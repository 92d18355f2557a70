"""What each filter removes in every order: an audit of filter interactions by CUBE.

A document has one flag for each filter it fails. Documents are counted by part and flags; a CUBE over the flags and the part
of these few counts gives every grouping set, and the row of a set of flags that are all false counts the documents
that pass these filters, whatever the others say: the survivors of the subset. A step of an order goes from the subset of the filters
before it to that with its own, so its figures are differences of a pair of subsets. There are 80 such pairs, joined
once each; the orders only list them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least distinct words and most capitals in per cent, and signs.
WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, r"[#$%&*|]"
CAPITAL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUMS = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITAL_LETTERS, ""))
    return {"A": n < WORDS, "B": 100 * distinct.cast("long") < DISTINCT * n.cast("long"), "C": 100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"), "D": text.rlike(SIGNS)}


def cells(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``n``, ``good``, ``toxic`` by ``part`` and the flags A to E, written as a table.

    Texts are read once, and only flags, two hashes and the key of a row go on. Texts are compared by 128 bits of hash: rows of texts
    that come more than once meet the smallest key with theirs, those of hot texts by broadcast, and move from E false to E true.
    """
    spark = docs.sparkSession
    tables = store.Tables(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    flags = failures(F.col("t"))
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("t"))
    narrow = slim.select("key", "part", *[c.alias(f) for f, c in flags.items()], F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(12), "t").alias("h2"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("good = 1 OR toxic = 1")
    named = narrow.where("key IS NOT NULL").join(marks, "key", "left")
    nameless = narrow.where("key IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    rows = tables.cut(named.unionByName(nameless).fillna(0, ["good", "toxic"]), "rows")
    same = rows.where("key IS NOT NULL").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("many"))
    same = tables.cut(same.where("least < most").drop("most"), "same")
    own = list(FILTERS[:-1])
    sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    copies = store.with_value(rows.where("key IS NOT NULL"), same, ["h1", "h2"], "many", rows.count(), whole=False).where("key > least")
    first = rows.select("part", *own, F.lit(False).alias("E"), F.lit(1).alias("n"), "good", "toxic")
    turned = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.lit(-1).alias("x")), F.struct(F.lit(True).alias("E"), F.lit(1).alias("x"))))
    later = copies.groupBy("part", *own).agg(*sums).withColumn("to", turned).select("part", *own, "to.E", *[(F.col(c) * F.col("to.x")).alias(c) for c in SUMS])
    both = first.groupBy("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in SUMS]).union(later)
    out = store.cut(both.groupBy("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n > 0"), "cells")
    tables.drop_all_but()
    return out


def survivors(counted: DataFrame) -> DataFrame:
    """``part`` (null: all parts together), ``subset`` (bit i: filter i is applied) and the sums of the documents that pass these filters; zeros included."""
    columns = ", ".join(FILTERS)
    # bit i of the subset: filter i is one of the grouping set's columns
    subset = " + ".join(f"(1 - grouping({f})) * {1 << i}" for i, f in enumerate(FILTERS))
    passed = " AND ".join(f"coalesce(NOT {f}, true)" for f in FILTERS)
    sums = ", ".join(f"sum({c}) AS {c}" for c in SUMS)
    cube = counted.sparkSession.sql(f"SELECT part, {columns}, grouping(part) AS g, {subset} AS subset, {sums} FROM {{cells}} GROUP BY CUBE({columns}, part)", cells=counted)
    found = cube.where(passed).select("part", "g", F.col("subset").cast("int").alias("subset"), *SUMS)
    every = counted.select("part").distinct().select("part", F.lit(0).alias("g"))
    every = every.union(every.groupBy().agg(F.count("*").alias("c")).where("c > 0").select(F.lit(None).cast("string"), F.lit(1)))
    dense = every.select("part", "g", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    filled = dense.alias("d").join(found.alias("f"), F.expr("d.part <=> f.part AND d.g = f.g AND d.subset = f.subset"), "left")
    return filled.select("d.part", "d.g", "d.subset", *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in SUMS])


def steps(spark) -> DataFrame:
    """``filter_order``, ``step``, ``name``, ``before`` and ``after`` (subsets): 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        done = 0
        for step, name in enumerate(order, 1):
            rows.append(("".join(order), step, name, done, done | 1 << FILTERS.index(name)))
            done = rows[-1][-1]
    return spark.createDataFrame(rows, "filter_order string, step int, name string, before int, after int")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step``: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``
    and ``shapley`` (the removed of the step's filter, summed over all orders), long; ``is_total`` is true, and ``part`` null, for all parts together.

    A null text is empty; a null part is the empty string. Filter E fails if a smaller key has the same text; rows without a key, and repeated
    rows among themselves, are nobody's copies. A document is good or toxic if any row of ``labels`` says so; labels without a key count
    for nothing. Repeated rows count as often as they come. An empty table gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    found = survivors(cells(docs, labels, part, text, key))
    listed = steps(spark)
    pairs = listed.select("name", "before", "after").distinct()
    last = len(FILTERS) - 1
    ways = F.element_at(F.array(*[F.lit(factorial(i) * factorial(last - i)) for i in range(last + 1)]), F.bit_count("before") + 1)
    was = found.select("part", "g", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in SUMS])
    now = found.select("part", "g", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in SUMS])
    pair = was.join(F.broadcast(pairs), "before").alias("w").join(now.alias("n"), F.expr("w.part <=> n.part AND w.g = n.g AND w.after = n.after"))
    lost = {c: F.col(f"{c}_before") - F.col(f"{c}_after") for c in SUMS}
    pair = pair.select("w.part", "w.g", "name", "before", F.col("n_after").alias("kept"), lost["n"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    full = F.lit((1 << len(FILTERS)) - 1)
    own = F.element_at(F.create_map(*[x for i, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << i))]), F.col("name"))
    alone = pair.groupBy("part", "g", "name").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == full - own, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    both = pair.alias("p").join(alone.alias("a"), F.expr("p.part <=> a.part AND p.g = a.g AND p.name = a.name"))
    both = both.select("p.part", "p.g", "p.name", "before", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = both.join(F.broadcast(listed.drop("after")), ["name", "before"])
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts], (F.col("g") == 1).alias("is_total"))

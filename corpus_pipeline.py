"""From raw documents to packed training sequences: five stages, each an operator of ``cytomill.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the next stage's documents. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytomill.llm import bytecnn, minmax, packing, repeats, risk, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is told with this probability at least, or the document goes.
LEAST_LANGUAGE = 0.3
#: Documents are near copies from this Jaccard similarity of their word shingles on, in per cent.
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled documents; those without a letter, or in none of the
    languages with LEAST_LANGUAGE, go."""
    net = bytecnn.train(docs.select("text", "lang"))
    found = bytecnn.identify(docs.select(*COLUMNS), net)
    return found.where((F.col("lang_pred") != bytecnn.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the certified cutoffs of their stratum go; those without an id are judged
    alike, and a value equal to its cutoff passes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return risk.judge(docs.select(*COLUMNS), labels, keep_text=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (a null one last); hashes break ties. Rows without
    a word link with nothing and stay. An id may be null or come again with another text, which is another document.
    Repeated rows are reduced to one where they are read, before rows of a document meet."""
    found = minmax.linked(docs, percent=PERCENT)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first).select(F.col("first.row_key").alias("_row"))
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy(F.xxhash64("lang", "source"), F.xxhash64("n_chars")))
    one = rows.where(word).withColumn("_n", nth).where("_n = 1")
    return one.join(kept, "_row", "left_semi").select(*COLUMNS).union(rows.where(~word).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go; documents of which nothing is left go with them. A text without such
    passages stays as it is."""
    found = repeats.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = found.where("n_removed < n_words").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("minmax_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]
#: The language network has no SQL form; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Domain views of the driver's tables: reads from ``lineitem``, a genome from ``documents``.

Each view is a list of expressions that Spark SQL and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index

#: Columns that tell the reads of one position and name apart.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
READS = (
    "l_orderkey as read_name",
    "concat('c', cast(l_orderkey % 3 as string)) as chrom",
    "cast(l_partkey % 24 as int) as start",
    "case when l_partkey % 3 = 0 then 'CG' when l_partkey % 3 = 1 then 'CHG' else 'CHH' end as motif",
    "case l_suppkey % 4 when 0 then 'c_bc' when 1 then 'c_bc_rv' when 2 then 'w_bc' else 'w_bc_rv' end as bs_strand",
    "l_linenumber % 2 = 1 as is_read1",
    "cast(floor(l_quantity) as int) % 42 as phred",
    "cast(round(l_tax * 100) as int) * 7 as mapq",
    "cast(floor(l_extendedprice) as bigint) % 600 as tlen",
    "cast(l_partkey % 101 as int) as pos_in_read",
    "case when round(l_discount * 100) <= 5 then 8 when round(l_discount * 100) <= 8 then 4 when round(l_discount * 100) = 9 then 2 else 16 end as status",
    "concat(substr('ACGT', cast(l_partkey % 4 + 1 as int), 1), substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1), 'C', substr('GACT', cast(l_partkey % 3 + 1 as int), 1), substr('ACGTN', cast(l_orderkey % 5 + 1 as int), 1)) as seq_context",
    *ORDER,
)
READS_SQL = f"SELECT {', '.join(READS)} FROM lineitem"


#: Alignments with three kinds of CIGAR, up to seven of a name, and the index positions they are piled up at.
ALIGNMENTS = (
    "concat('q', cast(l_orderkey as string)) as qname",
    "cast(case l_suppkey % 4 when 0 then 99 when 1 then 147 when 2 then 83 else 163 end as int) as flag",
    "concat('c', cast(l_orderkey % 3 as string)) as rname",
    "cast((l_partkey * 37 + l_linenumber * 11) % 30000 as bigint) as pos",
    "cast(round(l_tax * 100) as int) * 7 as mapq",
    "case l_linenumber % 3 when 0 then '60M' when 1 then '5S40M10D15M' else '30M2I28M' end as cigar",
    "cast(50 + l_partkey % 100 as bigint) as tlen",
    "substr(repeat('ACGTCGATTGCCGAN', 6), cast(l_partkey % 15 + 1 as int), 60) as seq",
    "substr(repeat('!5?IAB+', 12), cast(l_suppkey % 7 + 1 as int), 60) as qual",
    "cast(l_orderkey * 8 + l_linenumber as bigint) as file_ord",
)
#: The columns these are made of.
ALIGNED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax")
ALIGNMENTS_SQL = f"SELECT {', '.join(ALIGNMENTS)} FROM lineitem"
POSITIONS = (
    "concat('c', cast(p_partkey % 3 as string)) as chrom", "cast((p_partkey * 53) % 30000 as bigint) as start", "cast((p_partkey * 53) % 30000 + 1 as bigint) as \"end\"", "'CG' as motif", "'.' as score",
    "case when p_partkey * 53 % 30000 % 2 = 0 then '+' else '-' end as strand",
)
POSITIONS_SQL = f"SELECT DISTINCT {', '.join(POSITIONS)} FROM part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*READS)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ALIGNMENTS)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[e.replace('"', "`") for e in POSITIONS]).distinct()


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return index.whole_contigs(d.select(F.col("doc_id").alias("chrom"), F.upper(F.regexp_replace("text", "[^acgtnACGTN]", "")).alias("seq")))


GENOME_SQL = "SELECT cast(doc_id as varchar) AS chrom, upper(regexp_replace(text, '[^acgtnACGTN]', '', 'g')) AS seq FROM documents"

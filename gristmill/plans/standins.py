"""Relations of a change review, made from the star-schema tables.

The tables hold no diffs, coverage or lock files; these projections have the
shapes and the skews that the operators meet. Text formats are written out
line by line, so that the parsers read what the formats really look like.
``*_SQL`` has the same relation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_SQL = """hits AS (SELECT 'o' || l_orderkey AS file, l_linenumber AS line, SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(FLOOR(l_quantity) AS BIGINT) END) AS hits FROM lineitem GROUP BY 1, 2)"""
FN_SQL = """fn AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS file, o_orderpriority AS name, CAST(1 + o_orderkey % 15 AS INTEGER) AS cc, o_orderkey % 4 = 0 AS split FROM orders),
own AS (SELECT ord, file, i AS line FROM fn, range(2, 8) t(i) WHERE NOT (split AND i IN (3, 4)))"""
SCORED_SQL = f"""{HITS_SQL}, {FN_SQL},
cov AS (SELECT ord, AVG(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cov FROM own JOIN hits USING (file, line) GROUP BY ord),
scored AS (SELECT fn.*, cov, cc * cc * (1 - cov) * (1 - cov) * (1 - cov) + cc AS crap FROM fn LEFT JOIN cov USING (ord)),
risky AS (SELECT *, COALESCE(crap, CAST(cc * cc + cc AS DOUBLE)) AS risk FROM scored)"""
TOUCHED_SQL = """touched AS (SELECT DISTINCT 'o' || l_orderkey AS file, l_linenumber AS line FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""
CHURN_SQL = """churn AS (SELECT 'o' || user_id AS file, COUNT(*) AS commits FROM events GROUP BY 1)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_file(key: str = "o_orderkey") -> Column:
    return F.concat(F.lit("o"), F.col(key))


def hits(spark, d) -> DataFrame:
    n = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.floor("l_quantity").cast("long"))
    return table(spark, d, "lineitem").groupBy(order_file("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(F.sum(n).alias("hits"))


def functions(spark, d) -> DataFrame:
    none = F.array().cast("array<struct<a:int,b:int>>")
    nested = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.struct(F.lit(3).alias("a"), F.lit(4).alias("b")))).otherwise(none)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), order_file().alias("file"), F.col("o_orderpriority").alias("name"), (1 + F.col("o_orderkey") % 15).cast("int").alias("cc"),
        F.lit(1).alias("start"), F.lit(7).alias("end"), nested.alias("nested"),
    )


def touched(spark, d) -> DataFrame:
    late = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return late.select(order_file("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()


def churn(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.concat(F.lit("o"), F.col("user_id")).alias("file")).agg(F.count("*").alias("commits"))


def text_lines(rows: DataFrame, doc: str, order: list[str], lines: Column) -> DataFrame:
    """doc, ord, text: the lines that rows write, in the order of the rows; ord counts from the rows' order."""
    out = rows.select(F.col(doc).alias("doc"), F.array(*order).alias("_o"), F.posexplode(lines).alias("_i", "text"))
    return out.select("doc", F.struct("_o", "_i").alias("ord"), "text")


def document_lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


DOC_LINE_SQL = "doc_line AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS text, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)"

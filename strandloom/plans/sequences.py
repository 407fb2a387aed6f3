"""Sequence tables derived from the star-schema tables, in Spark and as SQL that gives the same rows.

templates: a 24-base sequence for every part.  reads: one read with one edit for every line item.  pairs: a template
and a mutated copy for every part.  drafts: every template with one base replaced and one missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import dealt

LENGTH = 24
_HEX, _TO = "0123456789abcdef", "ACGT" * 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("tid"), F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, LENGTH), _HEX, _TO).alias("tpl"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, rid, tpl, rd: by line number a base is missing, replaced, or an A inserted."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    rows = items.join(templates(spark, sf_dir), items["l_partkey"] == F.col("tid"))
    p = (F.lit(1) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % LENGTH).cast("int")
    rows = rows.withColumn("p", p)
    head, own, rest = F.expr("substring(tpl, 1, p - 1)"), F.expr("substring(tpl, p, 1)"), F.expr("substring(tpl, p + 1)")
    kind = F.col("l_linenumber") % 3
    read = F.when(kind == 0, F.concat(head, rest)).when(kind == 1, F.concat(head, F.translate(own, "ACGT", "CGTA"), rest)).otherwise(F.concat(head, own, F.lit("A"), rest))
    return rows.select("tid", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), "tpl", read.alias("rd"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, ref, query: one base replaced, up to three missing, and for every fourth part AC appended."""
    rows = dealt(templates(spark, sf_dir), "tid")
    query = F.expr("""concat(substring(tpl, 1, tid % 11), translate(substring(tpl, cast(tid % 11 + 1 as int), 1), 'ACGT', 'CGTA'),
        substring(tpl, cast(tid % 11 + 2 as int), cast(11 - tid % 11 + tid % 9 as int)), substring(tpl, cast(14 + tid % 9 + tid % 3 as int)), case when tid % 4 = 0 then 'AC' else '' end)""")
    return rows.select("tid", F.col("tpl").alias("ref"), query.alias("query"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(spark, sf_dir).select("tid", "tpl", F.concat(F.translate(F.substring("tpl", 1, 1), "ACGT", "CGTA"), F.substring("tpl", 2, 14), F.expr("substring(tpl, 17)")).alias("draft"))


SQL_TEMPLATES = f"templates AS (SELECT p_partkey AS tid, translate(substr(md5(p_partkey::VARCHAR), 1, {LENGTH}), '{_HEX}', '{_TO}') AS tpl FROM part)"
SQL_READS = SQL_TEMPLATES + f""",
    placed AS (SELECT l_orderkey, l_linenumber, tid, tpl, (1 + (l_orderkey * 7 + l_linenumber * 13) % {LENGTH})::INT AS p FROM lineitem JOIN templates ON l_partkey = tid),
    reads AS (SELECT tid, l_orderkey * 10 + l_linenumber AS rid, tpl,
        CASE l_linenumber % 3 WHEN 0 THEN substr(tpl, 1, p - 1) || substr(tpl, p + 1)
             WHEN 1 THEN substr(tpl, 1, p - 1) || translate(substr(tpl, p, 1), 'ACGT', 'CGTA') || substr(tpl, p + 1)
             ELSE substr(tpl, 1, p) || 'A' || substr(tpl, p + 1) END AS rd FROM placed)"""
SQL_PAIRS = SQL_TEMPLATES + """,
    pairs AS (SELECT tid, tpl AS ref, substr(tpl, 1, tid % 11) || translate(substr(tpl, tid % 11 + 1, 1), 'ACGT', 'CGTA') || substr(tpl, tid % 11 + 2, 11 - tid % 11 + tid % 9)
        || substr(tpl, 14 + tid % 9 + tid % 3) || CASE WHEN tid % 4 = 0 THEN 'AC' ELSE '' END AS query FROM templates)"""
SQL_DRAFTS = "drafts AS (SELECT tid, tpl, translate(substr(tpl, 1, 1), 'ACGT', 'CGTA') || substr(tpl, 2, 14) || substr(tpl, 17) AS draft FROM templates)"


def sql_edits(source: str, column: str, copies: int, deletions: int, longest: int = LENGTH) -> str:
    """SQL for (tid, pos, slot, edited) of all edits of a relation's column, which has at most `longest` bases."""
    n, base = f"length({column})", "substr('ACGT', s % 4 + 1, 1)"
    return f"""edits AS (SELECT tid, p AS pos, s AS slot,
        CASE WHEN s < 4 THEN substr({column}, 1, p) || {base} || substr({column}, p + 2) WHEN s < 8 THEN substr({column}, 1, p) || {base} || substr({column}, p + 1)
             WHEN s < {8 + copies} THEN substr({column}, 1, p + s - 7) || substr({column}, p + 1) ELSE substr({column}, 1, p) || substr({column}, p + 1 + s - {7 + copies}) END AS edited
        FROM {source}, (SELECT range::INT AS p FROM range(0, {longest + 1})), (SELECT range::INT AS s FROM range(0, {8 + copies + deletions}))
        WHERE CASE WHEN s < 4 THEN p < {n} WHEN s < 8 THEN p <= {n} WHEN s < {8 + copies} THEN p + s - 7 <= {n} ELSE p + s - {7 + copies} <= {n} END)"""

"""Contracts of published tables: each rule gives its violations as rows (rule, column, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = ("", "na", "n/a", "nan", "null", "none", "tbd")
LOCAL_PATH = r"(?i)([a-z]:\\|/home/|/users/|file://)"
CREDENTIAL = r"(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*\S+"


def https(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https://[^/\s]+"), F.lit(False))


def column_rules(df: DataFrame, required: list[str] = (), forbidden: list[str] = ()) -> list[tuple[str, str]]:
    """Schema violations, known without reading rows."""
    have = [c.lower() for c in df.columns]
    return ([("required_column", c) for c in required if c.lower() not in have] + [("forbidden_column", c) for c in forbidden if c.lower() in have]
            + [("duplicate_column", c) for c in sorted({c for c in have if have.count(c) > 1})])


def row_rules(df: DataFrame, key: list[str], not_blank: list[str] = (), checks: dict[tuple[str, str], Column] | None = None, min_rows: int = 1) -> DataFrame:
    """Counts of violating rows: one aggregate for all row rules, one for the key."""
    rules = {("blank", c): F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin(*MISSING), F.lit(True)) for c in not_blank}
    rules |= {k: ~F.coalesce(v, F.lit(False)) for k, v in (checks or {}).items()}
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.count_if(v).alias("n")) for (r, c), v in rules.items()]
    parts.append(F.struct(F.lit("min_rows").alias("rule"), F.lit("*").alias("column"), F.greatest(F.lit(0), F.lit(min_rows) - F.count("*")).cast("bigint").alias("n")))
    out = df.agg(F.array(*parts).alias("v")).select(F.inline("v"))
    copies = df.groupBy(*key).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n"))
    return out.unionByName(copies.select(F.lit("duplicate_key").alias("rule"), F.lit("+".join(key)).alias("column"), "n"))


def text_rules(columns: list[str]) -> dict[tuple[str, str], Column]:
    return {("local_path", c): ~F.coalesce(F.col(c).cast("string").rlike(LOCAL_PATH), F.lit(False)) for c in columns} | {("credential", c): ~F.coalesce(F.col(c).cast("string").rlike(CREDENTIAL), F.lit(False)) for c in columns}


def table_difference(left: DataFrame, right: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows on one side only, or whose values differ by more than the tolerance."""
    r = right.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_r"))
    both = left.withColumn("_l", F.lit(True)).join(r, key, "full_outer")
    far = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")) > tolerance, F.col(v).isNull() != F.col(f"_{v}").isNull()) for v in values])
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(far, "differs")
    return both.withColumn("side", side).where("side is not null").select(*key, "side")


def exactly_one(df: DataFrame, condition: Column) -> DataFrame:
    """The row that meets condition; none or several are an error when it is read."""
    n = df.where(condition).agg(F.count("*").alias("n"), F.any_value(F.struct(*df.columns)).alias("row"))
    return n.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("rows: "), F.col("n").cast("string")))).alias("row")).select("row.*")

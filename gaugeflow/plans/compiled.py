"""Contracts and claims compiled: all rules and claims on a table become one aggregate over one scan of it.

A Contract says what must hold of a table; compile_contract turns it into columns that mark violating rows. A Claim is a sentence whose numbers are aggregates of one table, and
an invariant over them. evaluate() merges everything asked of a table; only references to other tables cost a join, an anti-join each. Violations and claims are rows; raise_broken() raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import CREDENTIAL, LOCAL_PATH, MISSING, column_rules, https

#: Names of columns that a published table must not have, in any case, and patterns of values.
SENSITIVE = ("password", "secret", "token", "credential", "api_key")
SHA256 = r"^[0-9a-f]{64}$"
HEADING, LINK = r"(?is)<h[1-6][^>]*>", r"(?is)<a\s[^>]*href\s*="


@dataclass(frozen=True)
class Contract:
    """key: unique and not blank. counts: integers of at least 0. fractions: null or from 0 to 1. ids: relative, without steps upwards. safe: no local path or credential in the
    text. references: column -> (table, column) where every value must be found. checks: (rule, column) -> what must hold of each row."""

    table: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    not_blank: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    fractions: tuple[str, ...] = ()
    digests: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    urls: tuple[str, ...] = ()
    safe: tuple[str, ...] = ()
    min_rows: int = 1
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: dict[tuple[str, str], Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Claim:
    """A sentence with places for the aggregates, and an invariant over them."""

    claim: str
    table: str
    sentence: str
    parts: tuple[Column, ...]
    holds: Callable[..., Column]
    category: str = "observed data"


def normalized(text: Column) -> Column:
    """Text without markup and with white space as one space, for sentences that must stand in a page."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))


def holds_sentence(html: Column, sentence: str) -> Column:
    return F.contains(normalized(html), F.trim(F.regexp_replace(F.lit(sentence), r"\s+", " ")))


def _text(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def compile_contract(c: Contract) -> dict[tuple[str, str], Column]:
    """(rule, column) -> how many rows violate it, as an aggregate."""
    blank = lambda x: F.coalesce(F.lower(_text(x)).isin(*MISSING), F.lit(True))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    bad: dict[tuple[str, str], Column] = {}
    bad |= {("blank_key", x): F.coalesce(_text(x) == "", F.lit(True)) for x in c.key}
    bad |= {("blank", x): blank(x) for x in c.not_blank}
    bad |= {("nonnegative_integer", x): no(_text(x).rlike(r"^\+?\d+$")) for x in c.counts}
    bad |= {("fraction", x): F.col(x).isNotNull() & no(F.col(x).try_cast("double").between(0, 1)) for x in c.fractions}
    bad |= {("sha256", x): no(F.col(x).rlike(SHA256)) for x in c.digests}
    bad |= {("safe_id", x): no(~F.col(x).rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(F.split(x, r"[/\\]"), "..")) for x in c.ids}
    bad |= {("https", x): no(https(F.col(x))) for x in c.urls}
    bad |= {("local_path", x): F.coalesce(F.col(x).cast("string").rlike(LOCAL_PATH), F.lit(False)) for x in c.safe}
    bad |= {("credential", x): F.coalesce(F.col(x).cast("string").rlike(CREDENTIAL), F.lit(False)) for x in c.safe}
    bad |= {k: no(v) for k, v in c.checks.items()}
    out = {k: F.count_if(v) for k, v in bad.items()}
    out[("min_rows", "*")] = F.greatest(F.lit(0), F.lit(c.min_rows) - F.count("*")).cast("bigint")
    out[("duplicate_key", "+".join(c.key))] = F.count("*") - F.count_distinct(F.struct(*c.key))
    return out


def schema_violations(df: DataFrame, c: Contract) -> list[tuple[str, str]]:
    found = column_rules(df, c.required, c.forbidden)
    return found + [("sensitive_column", x) for x in df.columns if any(s in x.lower() for s in SENSITIVE)]


def _row(table: str, kind: str, name: str, column: str, n: Column, statement: Column, holds: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(table).alias("table"), F.lit(name).alias("name"), F.lit(column).alias("column"), n.cast("bigint").alias("n"), statement.alias("statement"), F.coalesce(holds, F.lit(False)).alias("holds"))


def _of_table(df: DataFrame, table: str, contracts: list[Contract], claims: list[Claim]) -> DataFrame:
    parts: list[Column] = []
    rows: list[Column] = []
    none = F.lit(None).cast("string")

    def part(x: Column) -> Column:
        parts.append(x.alias(f"p{len(parts)}"))
        return F.col(f"p{len(parts) - 1}")

    for c in contracts:
        rows += [_row(table, "rule", rule, column, F.lit(1), none, F.lit(False)) for rule, column in schema_violations(df, c)]
        for (rule, column), violations in compile_contract(c).items():
            n = part(violations)
            rows.append(_row(table, "rule", rule, column, n, none, n == 0))
    for c in claims:
        own = [part(x) for x in c.parts]
        there = reduce(lambda a, x: a & x.isNotNull(), own, F.lit(True))  # a number that is missing makes no sentence
        rows.append(_row(table, "claim", c.claim, c.category, F.lit(None), F.when(there, F.format_string(c.sentence, *own)), c.holds(*own)))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def evaluate(tables: dict[str, DataFrame], contracts: list[Contract], claims: list[Claim] = ()) -> DataFrame:
    """(kind, table, name, column, n, statement, holds): rules with the number of violations, claims with their sentence (column has the category). A table that is asked of is
    read once, and once more for each reference from or to it."""
    out = None
    for table in sorted({c.table for c in contracts} | {c.table for c in claims}):
        one = _of_table(tables[table], table, [c for c in contracts if c.table == table], [c for c in claims if c.table == table])
        out = one if out is None else out.unionByName(one)
    for c in contracts:
        for column, (other, key) in c.references.items():
            missing = tables[c.table].where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).join(tables[other].select(F.col(key).alias("_v")), "_v", "left_anti")
            one = missing.agg(F.count("*").alias("n")).select(F.inline(F.array(_row(c.table, "rule", "reference", f"{column} in {other}.{key}", F.col("n"), F.lit(None).cast("string"), F.col("n") == 0))))
            out = out.unionByName(one)
    if out is None:
        raise ValueError("nothing to evaluate")
    return out


def raise_broken(found: DataFrame) -> DataFrame:
    """evaluate()'s rows; a broken rule or claim is an error when it is read."""
    said = F.concat_ws(" ", F.lit("broken"), "kind", "table", "name", "column")
    return found.withColumn("holds", F.when(F.col("holds"), True).otherwise(F.raise_error(said).cast("boolean")))

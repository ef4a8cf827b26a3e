"""Evidence tables: results joined to the decisions they rest on, and sentences computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_results(decisions: DataFrame, metrics: DataFrame, keys: list[str], reference: str = "zero_change") -> DataFrame:
    """decisions(keys, retained) with the retained model's and the reference's metrics(keys, model, mae, n_ok), one row each."""
    own = metrics.select(*keys, F.col("model").alias("retained"), F.col("mae").alias("retained_mae"), F.col("n_ok").alias("retained_n"))
    ref = metrics.where(F.col("model") == reference).select(*keys, F.col("mae").alias("reference_mae"))
    return decisions.join(own, [*keys, "retained"], "left").join(ref, keys, "left").withColumn("ratio", F.try_divide("retained_mae", "reference_mae"))


def claims(tables: dict[str, DataFrame], rules: list[tuple[str, str, str, list[Column], Column]]) -> DataFrame:
    """rules (id, table, sentence with %s-style places, aggregates, invariant over their aliases a0, a1, ...): one sentence per rule; a
    broken invariant is an error when the claim is read."""
    out = None
    for name, source, sentence, parts, holds in rules:
        agg = tables[source].agg(*[p.alias(f"a{i}") for i, p in enumerate(parts)])
        text = F.when(holds, F.format_string(sentence, *[F.col(f"a{i}") for i in range(len(parts))])).otherwise(F.raise_error(F.lit(f"claim {name} does not hold")).cast("string"))
        row = agg.select(F.lit(name).alias("claim"), F.lit(source).alias("evidence"), text.alias("statement"))
        out = row if out is None else out.unionByName(row)
    return out


def receipt(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each produced table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def settings(values: dict[str, object], spark) -> DataFrame:
    """A run's settings as a table (setting, value), in order of names; lists are joined."""
    shown = lambda v: ";".join(map(str, v)) if isinstance(v, (list, tuple, set, frozenset)) else str(v)
    return spark.createDataFrame([(k, shown(values[k])) for k in sorted(values)], "setting string, value string")


def forecast_settings() -> dict[str, object]:
    """The settings of a rolling run."""
    from . import changepoints, forecast

    return {"horizons_days": forecast.HORIZONS, "minimum_calendar_days": forecast.MIN_DAYS, "minimum_targets": forecast.MIN_TARGETS, "minimum_mase_pairs": forecast.MIN_PAIRS, "minimum_equations": forecast.MIN_EQUATIONS,
            "minimum_past_residuals": forecast.MIN_RESIDUALS, "models": forecast.COMPLEXITY, "arima_orders": [f"{k}={v}" for k, v in forecast.ARIMA.items()], "pelt_multipliers": changepoints.SETTINGS, "binary_breaks": changepoints.SPLITS}


def software_versions(spark) -> DataFrame:
    import platform

    import numpy
    import pandas
    import pyarrow

    rows = [("python", platform.python_version()), ("spark", spark.version), ("numpy", numpy.__version__), ("pandas", pandas.__version__), ("pyarrow", pyarrow.__version__)]
    return spark.createDataFrame(rows, "name string, version string")

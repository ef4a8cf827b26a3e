"""Extension: quality flags and clusters on unbounded inputs, with the batch rules where order allows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_value_flags(df: DataFrame) -> DataFrame:
    """Stateless: the batch value flags hold row by row."""
    from ..operators.quality import value_flags

    return value_flags(df)


def stream_clusters(df: DataFrame, gap: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """Sessions per sensor: a new one after a gap."""
    return (df.withWatermark("ts", watermark).groupBy("sensor", F.session_window("ts", gap))
            .agg(F.count("*").alias("n"), F.max("value").alias("highest")).select("sensor", F.col("session_window.start").alias("first_ts"), "n", "highest"))


def stream_step_flags(df: DataFrame, expected_min: float = 15.0, watermark: str = "1 day") -> DataFrame:
    """Step from the previous row of each member, kept as state; rows of a batch are taken in row order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("row_no")
            before = pdf["ts"].shift(1)
            if last is not None:
                before.iloc[0] = last
            delta = (pdf["ts"] - before).dt.total_seconds() / 60
            last = pdf["ts"].iloc[-1]
            yield pd.DataFrame({"member": pdf["member"], "row_no": pdf["row_no"], "delta_min": delta, "flag_gap_before": (delta > expected_min).fillna(False), "flag_out_of_order_timestamp": (delta < 0).fillna(False)})
        if last is not None:
            state.update((last.isoformat(),))

    return (df.withWatermark("ts", watermark).groupBy("member").applyInPandasWithState(
        step, "member string, row_no bigint, delta_min double, flag_gap_before boolean, flag_out_of_order_timestamp boolean", "last string", "append", GroupStateTimeout.NoTimeout))

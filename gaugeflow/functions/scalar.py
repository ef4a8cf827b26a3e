"""Column expressions shared by the operators: fixed-offset time, water years, number parsing, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that spell a non-finite number, sentinel readings, and normal quantiles of 80 % and 95 % intervals.
NONFINITE_TOKENS = ("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity")
SENTINELS = (-9999.0, -999.0, -99.99, 999.0, 9999.0)
Z = {0.80: 1.2815515655446004, 0.95: 1.959963984540054}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_stamp(text: Column, style: str = "M/d/yyyy H:mm") -> Column:
    """Local time without zone; null where the text does not parse."""
    return F.try_to_timestamp(F.trim(text), F.lit(style)).cast("timestamp_ntz")


def to_utc(local: Column, offset_hours: int = 8) -> Column:
    """UTC of a fixed-offset local time, in any season."""
    return local + F.make_dt_interval(hours=F.lit(offset_hours))


def water_year(when: Column) -> Column:
    """The calendar year, or the next from October on."""
    return F.year(when) + (F.month(when) >= 10).cast("int")


def wet_season(when: Column) -> Column:
    return F.month(when).isin(10, 11, 12, 1, 2, 3, 4)


def minutes_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(60_000_000.0)


def parse_number(text: Column) -> Column:
    """A plain decimal or exponent number, or an infinity; null for anything else, NaN included."""
    t = F.lower(F.trim(text))
    return (F.when(t.rlike(_NUMBER), t.try_cast("double"))
            .when(t.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
            .when(t.isin("-inf", "-infinity"), F.lit(float("-inf"))))


def is_nonfinite(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*NONFINITE_TOKENS) | F.coalesce(F.abs(parse_number(text)) == float("inf"), F.lit(False))


def sensor_of_column(column: Column, sensors: list[str]) -> Column:
    """The sensor whose id ends the column name after an underscore; several matches are an error."""
    found = F.array_compact(F.array(*[F.when(column.endswith(f"_{s}"), F.lit(s)) for s in sensors]))
    return F.when(F.size(found) > 1, F.raise_error(F.concat(F.lit("ambiguous column "), column)).cast("string")).otherwise(F.get(found, 0))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; null for fewer than three pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(F.when(both, 1)) >= 3, r)


def adjusted_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(x))


def adjusted_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when((n >= 4) & (F.var_pop(x) > 0), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def interval_score(observed: Column, lower: Column, upper: Column, level: float) -> Column:
    """Winkler's score: width, and 2/alpha for each unit outside."""
    k = 2.0 / (1.0 - level)
    return (upper - lower) + k * F.greatest(lower - observed, F.lit(0.0)) + k * F.greatest(observed - upper, F.lit(0.0))


def joined_set(x: Column, sep: str = ";") -> Column:
    return F.array_join(F.sort_array(F.collect_set(x)), sep)


def measurement_role(product: Column, sensor: Column, ordinal: Column, rain: list[str]) -> Column:
    """What a field measures: rain stands twice in 15-minute files, first by interval and then cumulative, and as the day's maximum in daily ones."""
    is_rain = sensor.isin(*rain) if rain else F.lit(False)
    daily = F.when(is_rain, "daily_rainfall_maximum").otherwise("daily_median")
    fine = F.when(is_rain & (ordinal == 2), "cumulative_precipitation").when(is_rain, "interval_precipitation").otherwise("15_minute_observation")
    return F.when(product == "daily", daily).otherwise(fine)


def is_cumulative(role: Column, sensor: Column, extensometers: list[str]) -> Column:
    """Series whose values only grow but for resets."""
    grows = role.isin("cumulative_precipitation", "daily_rainfall_maximum")
    return grows | sensor.isin(*extensometers) if extensometers else grows


def product_of_archive(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("15_minute"), "15_minute").when(low.contains("daily"), "daily").otherwise("unknown")


def station_of_member(name: Column, stations: tuple[str, ...] = ("middle", "toe", "upper")) -> Column:
    out = F.when(F.lower(name).contains(stations[0]), stations[0])
    for s in stations[1:]:
        out = out.when(F.lower(name).contains(s), s)
    return out.otherwise("unknown")


def water_year_of_member(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)WY(\d{4})", 1), F.lit("")), F.lit("not_applicable"))

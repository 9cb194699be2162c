"""Row numbers and running sums over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def draw(seed: int | str | Column, key: Column | str) -> Column:
    """A seeded uniform draw in [0, 2**32), the same in any SQL engine that has md5."""
    key = F.col(key) if isinstance(key, str) else key
    seed = F.concat(seed, F.lit(":")) if isinstance(seed, Column) else F.lit(f"{seed}:")
    return F.conv(F.substring(F.md5(F.concat(seed, key.cast("string"))), 1, 8), 16, 10).cast("long")


def draw_sql(seed: int | str, key: str) -> str:
    """``draw`` in DuckDB's SQL."""
    return f"cast('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8) as bigint)"


def _code(kind: T.DataType, c: Column) -> Column:
    """A double in the order of ``c``; for text that of its first six bytes, so different texts may share one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def doubles(values) -> Column:
    """An array of doubles, made in one call however many there are."""
    return F.expr("array(" + ", ".join(f"double('{float(v)!r}')" for v in values) + ")")


def _cuts(df: DataFrame, codes: dict[str, Column], n: int) -> dict[str, list[float]]:
    row = df.agg(*[F.percentile_approx(c, doubles(i / n for i in range(1, n)), 10_000).alias(k) for k, c in codes.items()]).first()
    return {k: sorted({c for c in row[k] or [] if c is not None}) for k in codes}


def _at(cuts: list[float], code: Column) -> Column:
    """How many cuts lie at or below."""
    return F.coalesce(F.size(F.filter(doubles(cuts), lambda c: c <= code)), F.lit(0)) if cuts else F.lit(0)


def ranked(df: DataFrame, by: Column, ties: list[str], descending: bool = False, within: list[str] | None = None, sums: dict[str, Column] | None = None, buckets: int | None = None, uniform: bool = False) -> DataFrame:
    """df with ``rn``, the row number from 1 in the order by, ties, and a running sum (this row included) for each of ``sums``.

    Rows are split into ranges of ``by`` at approximate quantiles; one small aggregate gives what lies before each range, and
    windows run inside ranges only. A value that many rows share is a quantile, hence a range of its own, and split on at the
    quantiles of the first of ``ties`` (unless ``by`` is text). ``within`` restarts the numbering for each combination of those
    columns. The table of ranges depends on ``buckets``, not on the number of rows. Null keys come first, or last if descending.
    A ``uniform`` key is a ``draw``: its ranges are known beforehand, so no quantiles are sought and no row is held against a list of cuts.
    """
    within, sums = within or [], sums or {}
    spark = df.sparkSession
    n = buckets or min(1000, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = df.select(by).schema[0].dataType
    codes = {"key": _code(kind, by)}
    if ties and not uniform:
        codes["tie"] = _code(df.schema[ties[0]].dataType, F.col(ties[0]))
    cuts = {"key": []} if uniform else _cuts(df, codes, n)
    d = df.withColumn("_key", by).withColumn("_code", codes["key"])
    for name, value in sums.items():
        d = d.withColumn(f"_s_{name}", value)
    at = _at(cuts["key"], F.col("_code"))
    point = F.array_contains(doubles(cuts["key"]), F.col("_code")) if cuts["key"] else F.lit(False)
    bucket = F.when(F.col("_code").isNull(), -1).otherwise(F.floor(F.col("_code") * (n / 2**32)) if uniform else 2 * at - point.cast("int"))
    same = F.lit(False) if uniform else point & (F.abs("_code") < 2.0**53) if ties and not isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType)) else F.lit(False)
    d = d.withColumn("_bucket", (-bucket if descending else bucket).cast("int"))
    d = d.withColumn("_part", F.when(same, _at(cuts.get("tie", []), codes.get("tie", F.lit(0.0)))).otherwise(0).cast("int"))
    totals = d.groupBy(*within, "_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{s}").alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*within).orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_bucket").alias("_wb"), F.col("_part").alias("_wp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    order = [F.desc("_key") if descending else F.asc("_key"), *ties]
    w = Window.partitionBy(*within, "_bucket", "_part").orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    on = (d["_bucket"] == offset["_wb"]) & (d["_part"] == offset["_wp"])
    for c in within:
        on = on & d[c].eqNullSafe(offset[f"_w_{c}"])
    out = d.join(offset, on).withColumn("rn", F.row_number().over(w) + F.col("_b"))
    for s in sums:
        out = out.withColumn(s, F.sum(f"_s_{s}").over(rows) + F.col(f"_b_{s}"))
    return out.select(*df.columns, "rn", *sums)

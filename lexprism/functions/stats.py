"""Small statistical column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_QUANTILES = (
    12.706204736175, 4.302652729749, 3.182446305284, 2.776445105198, 2.570581835636,
    2.446911851145, 2.364624251593, 2.306004135204, 2.262157162798, 2.228138851986,
    2.200985160092, 2.178812829667, 2.160368656463, 2.144786687918, 2.13144954556,
    2.119905299221, 2.109815577833, 2.100922040241, 2.093024054408, 2.085963447266,
    2.079613844728, 2.073873067904, 2.068657610419, 2.063898561628, 2.059538552753,
    2.055529438643, 2.05183051648, 2.048407141795, 2.045229642133, 2.042272456301,
)
NORMAL_QUANTILE = 1.959963984540054


def t_quantile(degrees: Column) -> Column:
    """Student-t 0.975 quantile: table to 30 degrees, asymptotic series beyond."""
    z = NORMAL_QUANTILE
    n = degrees.cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    series = F.lit(z) + F.lit(g1) / n + F.lit(g2) / (n * n) + F.lit(g3) / (n * n * n) + F.lit(g4) / (n * n * n * n)
    table = F.array(*[F.lit(value) for value in T_QUANTILES])
    return F.when(degrees < 1, F.lit(None)).when(degrees <= 30, F.get(table, degrees.cast("int") - 1)).otherwise(series)


def finite_or_null(column: Column) -> Column:
    """Null for NaN and infinities, as JSON has no such numbers."""
    return F.when(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), F.lit(None)).otherwise(column)


def period_label(timestamp: Column, grain: str) -> Column:
    """Calendar period names: 2025-01-05, 2024-12-30/2025-01-05, 2025-01, 2025Q1."""
    if grain == "day":
        return F.date_format(timestamp, "yyyy-MM-dd")
    if grain == "week":
        monday = F.date_trunc("week", timestamp).cast("date")
        return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))
    if grain == "month":
        return F.date_format(timestamp, "yyyy-MM")
    return F.concat(F.year(timestamp).cast("string"), F.lit("Q"), F.quarter(timestamp).cast("string"))

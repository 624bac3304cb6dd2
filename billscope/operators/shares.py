"""Dominant values per group and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billscope.functions.text import round2
from billscope.operators.keyed import attach
from billscope.operators.stats import with_share


def mode_with_share(
    tokens: DataFrame, cluster: str, token: str, position: Sequence[str],
    theme: str = "theme", freq: str = "freq", pct: str = "pct",
) -> DataFrame:
    """Most frequent token per cluster, its count and percentage; ties go to the first seen.

    Counting per (cluster, token) comes first, so the second step sees distinct tokens
    only and picks its winner with a map-side maximum instead of a window.
    """
    counts = tokens.where(F.col(token).isNotNull()).groupBy(cluster, token).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*position)).alias("_first")
    )
    return counts.groupBy(cluster).agg(
        F.min_by(token, F.struct((-F.col("_n")).alias("n"), "_first")).alias(theme),
        F.max("_n").alias(freq),
        F.sum("_n").alias("_all"),
    ).select(cluster, theme, freq, round2(F.col(freq) / F.col("_all") * 100).alias(pct))


def theme_rollup(
    summary: DataFrame, cluster: str = "cluster", theme: str = "theme", freq: str = "freq"
) -> DataFrame:
    """Per theme its clusters, total frequency and share of the grand total."""
    grouped = summary.groupBy(theme).agg(
        F.sort_array(F.collect_list(cluster)).alias("clusters"), F.sum(freq).alias("freq_total")
    )
    shared = with_share(grouped, "freq_total", "_pct")
    return shared.select(theme, "clusters", "freq_total", round2(F.col("_pct")).alias("pct_total")).orderBy(
        F.col("freq_total").desc(), theme
    )


def assign_theme(rows: DataFrame, summary: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Each row with its cluster's theme; null for a cluster without one."""
    return attach(rows, [cluster], summary)


def percent_of_total(
    counts: DataFrame, group: str, measure: str, of_group: str = "pct_group", of_all: str = "pct_all"
) -> DataFrame:
    """Measure as a percentage of its group and of the grand total."""
    per_group = counts.groupBy(group).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(measure).alias("_group_total")
    )
    out = attach(counts, [group], per_group)
    out = out.withColumn(of_group, F.try_divide(F.col(measure) * 100.0, F.col("_group_total")))
    return with_share(out.drop("_group_total"), measure, of_all)


def head_per_group(df: DataFrame, group: str, order: Sequence[str], n: int = 3) -> DataFrame:
    """First n rows per group; Spark cuts each map partition to n per group before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def arg_max(df: DataFrame, keys: Sequence[str], candidate: str, score: Column, name: str) -> DataFrame:
    """Candidate of the greatest score; the smallest candidate wins a tie."""
    best = F.min_by(candidate, F.struct((-score).alias("s"), F.col(candidate)))
    return df.groupBy(*keys).agg(best.alias(name), F.max(score).alias("score"))

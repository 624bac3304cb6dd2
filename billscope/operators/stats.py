"""Counts, rates and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.operators.keyed import attach
from billscope.operators.lookup import mapped
from billscope.operators.ordered import quantiles
from billscope.shared import settle


def value_counts(
    df: DataFrame, column: str, count: str = "count", labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Occurrences per value, nulls left out, most frequent first."""
    out = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias(count))
    if labels:
        out = out.withColumn(column, mapped(F.col(column).cast("string"), labels))
    return out.orderBy(F.col(count).desc(), column)


def with_share(df: DataFrame, measure: str, share: str, scale: float = 100.0) -> DataFrame:
    """Measure as a share of its grand total, which is read as a single value."""
    total = df.agg(F.sum(measure).alias("t")).scalar()
    return df.withColumn(share, F.try_divide(F.col(measure) * F.lit(scale), total))


def share_of_total(df: DataFrame, column: str, share: str = "share") -> DataFrame:
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count", share)


def list_counts(df: DataFrame, items: Column, name: str, count: str = "count") -> DataFrame:
    """Occurrences of each element of a multi-valued column."""
    return (
        df.select(F.explode(items).alias(name))
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias(count))
    )


def count_and_sum(
    df: DataFrame, keys: Sequence[str], counted: Column, flag: Column,
    count: str = "submitted", total: str = "approved",
) -> DataFrame:
    """Non-null count and number of true flags per group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(counted).alias(count), F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias(total)
    )


def rate(part: str, whole: str) -> Column:
    """Percentage; a zero whole gives null."""
    return F.try_divide(F.col(part) * F.lit(100.0), F.col(whole))


def rate_by_group(
    counts: DataFrame, bloc: Column, count: str = "submitted", total: str = "approved"
) -> DataFrame:
    """Approval percentage per group with its bloc; groups without a bloc are left out."""
    return (
        counts.withColumn("bloc", bloc)
        .withColumn("rate", rate(total, count))
        .dropna("any")
        .orderBy(F.col("rate").desc(), counts.columns[0])
    )


def rate_two_level(
    counts: DataFrame, bloc: str, count: str = "submitted", total: str = "approved"
) -> DataFrame:
    """Group sums added up per bloc, then the percentage."""
    summed = counts.dropna(subset=[bloc]).groupBy(bloc).agg(
        F.sum(count).alias(count), F.sum(total).alias(total)
    )
    return summed.withColumn("rate", rate(total, count))


def fixed_category_counts(
    df: DataFrame, column: Column, categories: Sequence[str], name: str, count: str = "count"
) -> DataFrame:
    """Counts for exactly the given categories in one pass, zero where none occurs."""
    tallies = df.agg(*[F.count_if(column == c).alias(f"c{i}") for i, c in enumerate(categories)])
    cells = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(f"c{i}").alias(count)) for i, c in enumerate(categories)
    ])
    return tallies.select(F.explode(cells).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of each numeric column."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"),
                  F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("count"), F.col(f"m_{c}").alias("mean"),
            F.col(f"s_{c}").alias("std"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
        )
        for c in columns
    ])
    plain = df.agg(*parts).select(F.explode(cells).alias("r")).select("r.*")
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    quartiles = quantiles(tall, ["column_name"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, source=tall).drop("n")
    return plain.join(quartiles, "column_name", "left")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, each pair over its complete rows, all from one aggregate."""
    pairs = [(a, a) for a in columns] + list(combinations(columns, 2))
    values = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
    ])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")))
    return values.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def row_shares(df: DataFrame, columns: Sequence[str], total: str = "total") -> DataFrame:
    """Row total over the columns (null counts as 0) and each column as a percentage of it."""
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    out = df.withColumn(total, whole)
    return out.withColumns({c: rate(c, total) for c in columns})


def _range(df: DataFrame, column: str) -> Column:
    x = F.col(column).cast("double")
    return df.agg(F.struct(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.stddev_samp(x).alias("sd")
    ).alias("r")).scalar()


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed, empty ones included."""
    x = F.col(column).cast("double")
    flat = F.col("_r.hi") <= F.col("_r.lo")
    low = F.when(flat, F.col("_r.lo") - 0.5).otherwise(F.col("_r.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_r.hi") - F.col("_r.lo")) / bins
    counted = (
        df.where(x.isNotNull())
        .select(x.alias("_x"))
        .withColumn("_r", _range(df, column))
        .groupBy(F.least(F.floor((F.col("_x") - low) / width) + 1, F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).withColumn("_r", _range(df, column))
    return edges.join(counted, "bin", "left").where(F.col("_r.n") > 0).select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("low"),
        (low + F.col("bin") * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density on an even grid over [min, max], bandwidth std * n^(-1/5).

    Equal values are counted first; every grid point is then one sum of the same
    aggregate, so no (value, grid point) pair is ever emitted.
    """
    x = F.col(column).cast("double")
    counted = (
        df.where(x.isNotNull())
        .groupBy(x.alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_r", _range(df, column))
    )
    step = (F.col("_r.hi") - F.col("_r.lo")) / (points - 1)
    h = F.col("_r.sd") * F.pow(F.col("_r.n"), F.lit(-0.2))
    kernels = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.col("_n") * F.exp(
            -F.pow((F.col("_x") - (F.col("_lo") + i * F.col("_step"))) / F.col("_h"), F.lit(2.0)) / 2
        ),
    )
    rows = counted.select("_x", "_n", F.col("_r.lo").alias("_lo"), step.alias("_step"), h.alias("_h"))
    rows = rows.withColumn("_k", kernels)
    sums = rows.agg(*[F.sum(F.get("_k", F.lit(i))).alias(f"s{i}") for i in range(points)])
    tall = sums.select(F.posexplode(F.array(*[F.col(f"s{i}") for i in range(points)])).alias("point", "_s"))
    out = tall.withColumn("_r", _range(df, column))
    return out.select(
        "point",
        (F.col("_r.lo") + F.col("point") * step).alias("x"),
        (F.col("_s") / (F.col("_r.n") * h * F.lit(sqrt(2 * pi)))).alias("density"),
    )


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and outlier count per group."""
    marks = settle(quantiles(df.dropna(subset=[group]), [group], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    values = df.dropna(subset=[group, column]).select(group, column)
    placed = attach(values, [group], marks, weights=marks.select(group, F.col("n").alias("_rows")))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(column)
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return placed.groupBy(group).agg(
        F.max("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.least(F.min(F.when(inside, x)), F.max("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, x)), F.max("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each cleaning step, all from one pass."""
    kept = F.lit(True)
    tallies = [F.count(F.lit(1)).alias("c0")]
    for i, condition in enumerate(steps.values(), 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        tallies.append(F.count_if(kept).alias(f"c{i}"))
    cells = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"c{i}").alias("rows"))
        for i, name in enumerate(["all", *steps])
    ])
    return df.agg(*tallies).select(F.explode(cells).alias("r")).select("r.*")


def min_max_scale(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """(x - min) / (max - min), null when all values are equal."""
    return df.withColumn("_r", _range(df, column)).withColumn(
        name, F.try_divide(F.col(column).cast("double") - F.col("_r.lo"), F.col("_r.hi") - F.col("_r.lo"))
    ).drop("_r")


def ordered_list(df: DataFrame, key: str, value: str, order: Sequence[str], name: str,
                 separator: str = ", ", empty: str | None = None) -> DataFrame:
    """Values of each key in order as one text."""
    place = ", ".join(f"`{c}`" for c in order)
    text = F.expr(f"listagg(`{value}`, '{separator}') WITHIN GROUP (ORDER BY {place})")
    text = text if empty is None else F.coalesce(text, F.lit(empty))
    return df.groupBy(key).agg(text.alias(name))


def distinct_list(df: DataFrame, key: str, value: str, name: str, separator: str = ", ") -> DataFrame:
    """Distinct values of each key, sorted, as one text; repeats vanish before the shuffle."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), separator).alias(name))

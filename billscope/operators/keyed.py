"""Values per key brought back to the rows, safe for keys that hold a large share of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.operators.ordered import at_most

HOT_SHARE = 1000
SPREAD = 4096
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its rows and the bytes of its texts are few; otherwise Spark picks the join."""
    if not at_most(df, rows):
        return df
    narrow = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    sizes = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields if not isinstance(f.dataType, narrow)]
    if sizes:
        found = df.agg(*[F.sum(s.cast("long")).alias(f"s{i}") for i, s in enumerate(sizes)]).first()
        if sum(x or 0 for x in found) > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def spread_small_scan(df: DataFrame, key: str) -> DataFrame:
    """Deal out a scan that has fewer partitions than there are cores.

    Meant before work that is heavy per row; a scan with enough partitions stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _match(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> Column:
    same = None
    for i, k in enumerate(keys):
        pair = df[k].eqNullSafe(side[f"_k{i}"])
        same = pair if same is None else same & pair
    return same


def _spread(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if not _holds_map(f.dataType)]
    return F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int")


def _holds_map(kind: T.DataType) -> bool:
    text = kind.simpleString()
    return "map<" in text or "variant" in text


def attach(
    df: DataFrame,
    keys: Sequence[str],
    values: DataFrame,
    weights: DataFrame | None = None,
    hot_share: int = HOT_SHARE,
    check: bool = True,
    hot_when: Column | None = None,
) -> DataFrame:
    """Left-join one row of ``values`` per key to the rows of ``df``.

    Values that a check shows to be few are broadcast: a table of its own when it is
    short, aggregates of ``df`` itself (they carry ``_rows``, the row count per key) when
    ``df`` is. Otherwise, or without ``check``, keys with more than 1/``hot_share`` of the
    rows are hot; there are fewer than ``hot_share`` of them whatever the data, so their
    values are broadcast. Hot rows then pass the second join under a spread-out salt that
    matches nothing, and cold rows meet their value in an ordinary shuffle join.
    ``weights`` (keys, ``_rows``) defaults to the row counts of ``df``; ``hot_when`` is
    another bounded test for hot keys, where one is known.
    """
    names = [c for c in values.columns if c not in keys and c != "_rows"]
    counted = "_rows" in values.columns
    drop_keys = [f"_k{i}" for i in range(len(keys))]
    if check and at_most(df if counted else values, BROADCAST_ROWS):
        side = _keyed(values, keys, names)
        return df.join(F.broadcast(side), _match(df, side, keys), "left").drop(*drop_keys)
    if counted:
        weighed = values
    else:
        if weights is None:
            weights = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        weighed = _keyed(weights, keys, ["_rows"])
        weighed = values.join(weighed, _match(values, weighed, keys), "inner").drop(*drop_keys)
    if hot_when is None:
        hot_when = F.col("_rows") * hot_share > weighed.agg(F.sum("_rows").alias("t")).scalar()
    weighed = weighed.withColumn("_hot", hot_when)
    box = F.struct(*names)
    hot = weighed.where("_hot").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], box.alias("_hv")
    )
    cold = weighed.where(~F.col("_hot")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        box.alias("_cv"),
        F.lit(-1).alias("_s"),
    )
    out = df.join(F.broadcast(hot), _match(df, hot, keys), "left").drop(*drop_keys)
    out = out.withColumn("_salt", F.when(F.col("_hv").isNotNull(), _spread(df)).otherwise(F.lit(-1)))
    out = out.join(cold, _match(out, cold, keys) & (out["_salt"] == cold["_s"]), "left")
    picked = F.coalesce("_hv", "_cv")
    return out.select(*df.columns, *[picked[n].alias(n) for n in names])


def _keyed(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names)


def attach_aggregates(
    df: DataFrame, keys: Sequence[str], *aggregates: Column, hot_share: int = HOT_SHARE, check: bool = True
) -> DataFrame:
    """Add aggregates of the row's own key to every row (a window without its hot task)."""
    values = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return attach(df, keys, values, hot_share=hot_share, check=check)

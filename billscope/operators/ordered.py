"""Ordered work (ranks, running sums, neighbours, quantiles) that no single key can swamp.

A window over one hot key would run in one task. Checks find the keys that are too large
for that - mostly there are none, and plain windows do. The rows of such keys are first cut into
chunks of consecutive rows at splitter values drawn from the data, the window runs
inside (key, chunk), and what crosses a chunk border is carried by one extra row per
(key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billscope.shared import settle

LEAST_CHUNKS = 64
MOST_CHUNKS = 8192
CHUNK = "_chunk"
UNCUT = -1
ONE_TASK_ROWS = 1_000_000
HOT_KEY_LIST = 10_000


def chunk_count(df: DataFrame) -> int:
    """As many chunks as the session has shuffle partitions, within bounds."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_CHUNKS, max(LEAST_CHUNKS, partitions))


def splitters(df: DataFrame, order: Sequence[str], chunks: int) -> DataFrame:
    """One row: at most ``chunks - 1`` rows' order values, sorted, and their leading values.

    Each hash class gives its row of greatest hash, a fixed random draw. The draw only
    aggregates numbers; a second look at the table fetches the values behind them.
    """
    rows = df.select(*order).withColumn("_h", F.xxhash64(*order))
    rows = rows.withColumn("_class", F.pmod("_h", F.lit(chunks - 1)).cast("int"))
    every_class = df.sparkSession.range(chunks - 1).select(
        F.col("id").cast("int").alias("_class"), F.lit(None).cast("long").alias("_h")
    )
    drawn = (
        rows.select("_class", "_h")
        .unionByName(every_class)
        .groupBy("_class")
        .agg(F.max("_h").alias("h"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_class", "h"))), lambda r: r["h"]).alias("all"))
        .scalar()
    )
    picked = rows.withColumn("_drawn", drawn).where(F.get("_drawn", F.col("_class")) == F.col("_h"))
    bounds = F.sort_array(F.collect_set(F.struct(*order)))
    return picked.agg(bounds.alias("rows")).select(
        F.struct(F.transform("rows", lambda r: r[order[0]]).alias("leads"), "rows").alias("bounds")
    )


def _lead_place(lead: Column, leads: Column, chunks: int) -> Column:
    """How many splitters have a smaller leading value: log2(chunks) plain comparisons."""
    jumps = [1 << i for i in reversed(range((chunks - 1).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(j) for j in jumps]),
        F.lit(0),
        lambda at, jump: F.when(F.try_element_at(leads, at + jump) < lead, at + jump).otherwise(at),
    )


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the table has no more rows than that.

    Spark reads partition after partition only until the limit is passed.
    """
    return not df.select(F.lit(1)).offset(rows).limit(1).collect()


def with_chunks(
    df: DataFrame,
    order: Sequence[str],
    chunks: int | None = None,
    source: DataFrame | None = None,
    keep: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the number of the chunk a row falls into under the given ascending order.

    The leading column decides; only rows that share a splitter's leading value look at
    the other columns, so even a heavily repeated leading value is cut up.

    Without an explicit number of chunks, a table is left alone when it fits one task or
    when each of its ``keys`` does; otherwise only the rows of the keys that do not are
    cut up. These checks look at ``source`` if given: a table with the same keys and no
    fewer rows that is cheaper to read. Chunking reads its input several times; ``keep``
    writes a costly input down first.
    """
    hot = None
    if chunks is None:
        seen = df if source is None else source
        if at_most(seen, ONE_TASK_ROWS):
            return df
        if keys:
            hot = hot_keys(seen, keys)
            if hot is not None and not hot:
                return df
        chunks = chunk_count(df)
    if keep:
        df = settle(df)
    marked = df.withColumn("_cut", F.lit(True)) if hot is None else _mark_keys(df, keys, hot)
    bounds = splitters(marked.where("_cut"), order, chunks).scalar()
    out = marked.withColumn("_bounds", bounds).withColumn("_leads", F.col("_bounds.leads"))
    lead, row = F.col(order[0]), F.struct(*order)
    place = F.when(F.col("_cut"), _lead_place(lead, F.col("_leads"), chunks)).otherwise(UNCUT)
    out = out.withColumn(CHUNK, place)
    if len(order) > 1:
        tied = F.col("_cut") & (F.get("_leads", F.col(CHUNK)) == lead)
        below = F.size(F.filter(F.col("_bounds.rows"), lambda b: (b[order[0]] == lead) & (b < row)))
        out = out.withColumn(CHUNK, F.when(tied, F.col(CHUNK) + below).otherwise(F.col(CHUNK)))
    return out.drop("_bounds", "_leads", "_cut")


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list | None:
    """The keys whose rows do not fit one task, or None when they are too many to list."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ONE_TASK_ROWS)
    found = large.select(*keys).limit(HOT_KEY_LIST + 1).collect()
    return None if len(found) > HOT_KEY_LIST else found


def _mark_keys(df: DataFrame, keys: Sequence[str], hot: list) -> DataFrame:
    """``_cut``: whether the row's key is in the short list."""
    listed = df.sparkSession.createDataFrame(hot, df.select(*keys).schema).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_listed")
    )
    same = [df[k].eqNullSafe(listed[f"_k{i}"]) for i, k in enumerate(keys)]
    marked = df.join(F.broadcast(listed), reduce(lambda a, b: a & b, same), "left")
    return marked.withColumn("_cut", F.col("_listed").isNotNull()).drop(
        "_listed", *[f"_k{i}" for i in range(len(keys))]
    )


def with_edges(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Add one carried row per (key, chunk): ``_edge`` -1 sorts it first, 1 sorts it last.

    A carried row takes part in the chunk's window like any other row, so it costs no join
    and the rows move once. ``_edge`` is 0 on the rows themselves.
    """
    return df.withColumn("_edge", F.lit(0)).unionByName(edges, allowMissingColumns=True)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key; with ``totals`` also ``<name>_total`` per key."""
    chunked = CHUNK in df.columns
    cut = [*keys, CHUNK] if chunked else list(keys)
    local = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not chunked:
        added = {n: F.sum(c).over(local) for n, c in sums.items()}
        if totals:
            added |= {f"{n}_total": F.sum(c).over(Window.partitionBy(*keys)) for n, c in sums.items()}
        return df.withColumns(added)
    parts = df.withColumns({f"_s_{n}": c for n, c in sums.items()})
    per_chunk = parts.groupBy(*cut).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edges = per_chunk.select(
        *cut,
        F.lit(-1).alias("_edge"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in sums if totals],
    )
    both = with_edges(parts.withColumns({f"{n}_total": F.lit(None) for n in sums if totals}), edges)
    up_to = Window.partitionBy(*cut).orderBy("_edge", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({n: F.sum(f"_s_{n}").over(up_to) for n in sums})
    if totals:
        out = out.withColumns({f"{n}_total": F.first(f"{n}_total", True).over(up_to) for n in sums})
    return out.where(F.col("_edge") == 0).drop("_edge", *[f"_s_{n}" for n in sums])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunks: int | None = None
) -> DataFrame:
    """1-based position of each row within its key under an ascending total order."""
    chunked = with_chunks(df, order, chunks, keys=keys)
    return running_sums(chunked, keys, order, {name: F.lit(1).cast("long")}).drop(CHUNK)


def _neighbour(df, keys, order, value, name, back):
    """Value of the row before (``back``) or after each row of the key."""
    step = F.lag if back else F.lead
    if CHUNK not in df.columns:
        return df.withColumn(name, step(value).over(Window.partitionBy(*keys).orderBy(*order)))
    cut = [*keys, CHUNK]
    boxed = df.withColumn("_box", F.struct(value.alias("v")))
    place = F.struct(*order)
    outermost = F.max_by("_box", place) if back else F.min_by("_box", place)
    edges = boxed.where(F.col(CHUNK) != UNCUT).groupBy(*cut).agg(outermost.alias("_box")).select(
        *cut,
        F.lit(-1 if back else 1).alias("_edge"),
        step("_box").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_box"),
    )
    near = step("_box").over(Window.partitionBy(*cut).orderBy("_edge", *order))
    out = with_edges(boxed, edges).withColumn("_near", near).where(F.col("_edge") == 0)
    return out.withColumn(name, F.col("_near.v")).drop("_edge", "_box", "_near")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Lag by one row within the key, across chunk borders."""
    return _neighbour(df, keys, order, value, name, back=True)


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Lead by one row within the key, across chunk borders."""
    return _neighbour(df, keys, order, value, name, back=False)


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    chunks: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, nulls left out.

    Equal values are counted first; ranks then come from running counts, so a group of
    any size is spread over its value chunks.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cut = with_chunks(counts, ["_x"], chunks, df if source is None else source, keep=True, keys=groups)
    ranked = running_sums(cut, groups, ["_x"], {"_c": F.col("_n")}, totals=True)
    picks = []
    for name, share in shares.items():
        at = (F.col("_c_total") - 1) * F.lit(float(share))
        picks += [
            F.min(F.when(F.col("_c") > F.floor(at), F.col("_x"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_c") > F.ceil(at), F.col("_x"))).alias(f"_hi_{name}"),
        ]
    edges = ranked.groupBy(*groups).agg(F.max("_c_total").alias("_n"), *picks)
    out = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * F.lit(float(share))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return edges.select(*groups, F.col("_n").alias("n"), *out)

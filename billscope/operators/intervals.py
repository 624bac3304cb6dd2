"""Validity intervals from event histories, and point-in-time questions on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billscope.functions.text import clean_symbol
from billscope.operators.keyed import attach_aggregates
from billscope.operators.lookup import mapped
from billscope.operators.ordered import (
    CHUNK,
    UNCUT,
    next_value,
    previous_value,
    row_numbers,
    with_chunks,
    with_edges,
)

NOT_FOUND = "Não encontrado"


def open_close_periods(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    day: Column,
    opens: Column,
    closes: Column,
    as_of: Column,
    start: str = "data_entrada",
    end: str = "data_saida",
    chunks: int | None = None,
) -> DataFrame:
    """Periods per key: closed + opens -> open, open + closes -> period; still open -> as_of.

    Seen as a function on {closed, open}, an event sets 1 (opens), sets 0 (closes) or
    toggles (both); all others are dropped first. The state after a row is the last set
    value plus the toggles since, mod 2 - and a whole chunk composes to such a function
    too, so states are carried from chunk to chunk on one row per (key, chunk).
    """
    on, off = F.coalesce(opens, F.lit(False)), F.coalesce(closes, F.lit(False))
    marks = events.select(key, *order, day.alias("_day"), on.alias("_on"), off.alias("_off"))
    marks = with_chunks(marks.where(F.col("_on") | F.col("_off")), order, chunks, events, keys=[key])
    chunked = CHUNK in marks.columns
    marks = marks.withColumns({
        "_set": F.when(~F.col("_off"), 1).when(~F.col("_on"), 0),
        "_flip": F.when(F.col("_on") & F.col("_off"), 1).otherwise(0),
    }).drop("_on", "_off")
    cut, place = [key], list(order)
    if chunked:
        cut, place = [key, CHUNK], ["_edge", *order]
        marks = with_edges(marks, _states_before_chunks(marks.where(F.col(CHUNK) != UNCUT), key, order))
    states = _running_states(marks, cut, place)
    before = F.lag("_state").over(Window.partitionBy(*cut).orderBy(*place))
    marks = states.withColumn("_before", F.coalesce(before, F.lit(0)))
    if chunked:
        marks = marks.where(F.col("_edge") == 0)
    changes = marks.where(F.col("_state") != F.col("_before")).select(
        key, *order, "_day", "_state", *[CHUNK] * chunked
    )
    closed = next_value(changes, [key], order, F.col("_day"), "_next")
    return closed.where(F.col("_state") == 1).select(
        key, F.col("_day").alias(start), F.coalesce("_next", as_of).alias(end)
    )


def _running_states(marks: DataFrame, cut: Sequence[str], place: Sequence[str]) -> DataFrame:
    """State after each row: the last set value (closed at first) plus the flips since."""
    so_far = Window.partitionBy(*cut).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flipped = marks.withColumn("_flips", F.sum("_flip").over(so_far))
    base = F.last((F.col("_set") + F.col("_flips")) % 2, True).over(so_far)
    return flipped.withColumn("_base", base).withColumn(
        "_state", (F.coalesce("_base", F.lit(0)) + F.col("_flips")) % 2
    )


def _states_before_chunks(marks: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One carried row per (key, chunk) that sets the state in which the chunk begins.

    A whole chunk sets a state or flips it, just as an event does.
    """
    last = _running_states(marks, [key, CHUNK], order).groupBy(key, CHUNK).agg(
        F.max_by(F.struct("_base", "_flips", "_state"), F.struct(*order)).alias("_e")
    )
    sets = F.col("_e._base").isNotNull()
    chunk_marks = last.select(
        key, CHUNK, F.when(sets, F.col("_e._state")).alias("_set"),
        F.when(sets, F.lit(0).cast("long")).otherwise(F.col("_e._flips")).alias("_flip"),
    )
    after = _running_states(chunk_marks, [key], [CHUNK])
    begins = F.coalesce(F.lag("_state").over(Window.partitionBy(key).orderBy(CHUNK)), F.lit(0))
    return after.select(
        key, CHUNK, F.lit(-1).alias("_edge"), begins.alias("_set"), F.lit(0).alias("_flip")
    )


def value_runs(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    day: Column,
    value: str,
    as_of: Column,
    start: str = "data_entrada_partido",
    end: str = "data_saida_partido",
    chunks: int | None = None,
    place: str | None = None,
) -> DataFrame:
    """Maximal runs of an equal value: (value, start, start of the next run, last -> as_of).

    A null run ends the one before it and is not given out itself. ``place`` names a further
    column, the order values of a run's first event: runs that begin on one day keep their
    order by it.
    """
    rows = events.select(key, *order, day.alias("_day"), F.col(value).alias("_v"))
    rows = with_chunks(rows, order, chunks, events, keys=[key])
    rows = previous_value(rows, [key], order, F.col("_v"), "_prev")
    changes = rows.where(~F.col("_v").eqNullSafe(F.col("_prev"))).drop("_prev")
    changes = next_value(changes, [key], order, F.col("_day"), "_next")
    return changes.where(F.col("_v").isNotNull()).select(
        key, F.col("_v").alias(value), F.col("_day").alias(start), F.coalesce("_next", as_of).alias(end),
        *([F.struct(*order).alias(place)] if place else []),
    )


def first_value_per_key(
    df: DataFrame, key: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """The value of the key's earliest row on every row of the key."""
    earliest = F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    return attach_aggregates(df, [key], earliest.alias("_first")).withColumn(
        name, F.col("_first.v")
    ).drop("_first")


def chronological_rank(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position in the key's own chronological order."""
    return row_numbers(df, [key], order, name)


def _months(start: Column, end: Column) -> Column:
    return F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))


def _spread(intervals: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval once for every month ``_m`` it touches between the first and the last of the days ``_d``."""
    span = days.agg(F.struct(F.min("_d").alias("low"), F.max("_d").alias("high")).alias("_span")).scalar()
    cut = intervals.withColumn("_span", span)
    low, high = F.greatest(F.col(start), F.col("_span.low")), F.least(F.col(end), F.col("_span.high"))
    touched = (F.col(start) <= F.col(end)) & F.col("_span.low").isNotNull() & (low <= high)
    return cut.where(touched).withColumn("_m", F.explode(_months(low, high)))


def active_on(
    intervals: DataFrame,
    days: DataFrame,
    day: str = "data",
    start: str = "data_entrada",
    end: str = "data_saida",
) -> DataFrame:
    """Every (day, interval) with start <= day <= end, both ends closed.

    Intervals are spread over the months they touch within the span of the days, so the
    range condition becomes an equality on the month; Spark broadcasts the days if their
    measured size allows.
    """
    wanted = days.select(F.col(day).cast("date").alias("_d")).distinct()
    spread = _spread(intervals, wanted, start, end)
    wanted = wanted.withColumn("_dm", F.trunc("_d", "MM"))
    inside = (spread["_m"] == wanted["_dm"]) & wanted["_d"].between(F.col(start), F.col(end))
    return spread.join(wanted, inside, "inner").select(F.col("_d").alias(day), *intervals.columns)


def first_match_on(
    lookups: DataFrame,
    intervals: DataFrame,
    key: str,
    value: str,
    day: str = "data",
    start: str = "data_entrada_partido",
    end: str = "data_saida_partido",
    order: Sequence[str] = (),
    default: str = NOT_FOUND,
) -> DataFrame:
    """For each (key, day) the value of the first covering interval, else the default.

    The join key is (key, month), which also cuts the history of one busy key into
    months; only months within the span of the days asked for are made. It is an inner join, so Spark may split the intervals of a busy month, and
    matches are reduced to one per (key, day) on the map side; days without a match come
    back by (key, day), unique on both sides. Repeated look-ups are counted first and given
    back at the end.
    """
    order = list(order) or [start]
    asked = lookups.groupBy(F.col(key).alias("_k"), F.col(day).cast("date").alias("_d")).agg(
        F.count(F.lit(1)).alias("_times")
    )
    spread = _spread(intervals, lookups.select(F.col(day).cast("date").alias("_d")), start, end)
    asked = asked.withColumn("_dm", F.trunc("_d", "MM"))
    covers = (
        (asked["_k"] == spread[key])
        & (asked["_dm"] == spread["_m"])
        & asked["_d"].between(spread[start], spread[end])
    )
    found = asked.join(spread, covers).groupBy(F.col("_k").alias("_fk"), F.col("_d").alias("_fd")).agg(
        F.min_by(F.col(value), F.struct(*order)).alias("_value")
    )
    answered = asked.join(found, (asked["_k"] == found["_fk"]) & (asked["_d"] == found["_fd"]), "left")
    copies = answered.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return copies.select(
        F.col("_d").alias(day), F.col("_k").alias(key),
        F.coalesce("_value", F.lit(default)).alias(value),
    )


def collect_members(
    df: DataFrame, keys: Sequence[str], members: Column, spread: Column, name: str,
    part_rows: int = 10_000,
) -> DataFrame:
    """Array of structs per key, in parts of about ``part_rows`` members.

    An ordinary key gives one row with ``part`` 0; a key with more members than fit
    comfortably in one cell gives several, and nothing is dropped. Only those large keys
    are looked up.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows)
    large = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    rows = df.select(*keys, members.alias("_m"), F.xxhash64(spread).alias("_h"))
    same = [rows[k].eqNullSafe(large[f"_k{i}"]) for i, k in enumerate(keys)]
    rows = rows.join(large, reduce(lambda a, b: a & b, same), "left")
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(part_rows)), F.lit(1))
    part = F.pmod(F.col("_h"), parts).cast("int")
    return rows.groupBy(*keys, part.alias("part")).agg(F.sort_array(F.collect_list("_m")).alias(name))


def bloc_counts(
    df: DataFrame,
    members: str,
    field: str,
    blocs: Mapping[str, str],
    columns: Mapping[str, str],
) -> DataFrame:
    """How many members of the row's array belong to each bloc, one column per bloc."""
    def bloc(member: Column) -> Column:
        return mapped(clean_symbol(member[field]), blocs)

    named = df.withColumn("_blocs", F.transform(F.coalesce(members, F.array()), bloc))
    def tally(wanted: str) -> Column:
        return F.size(F.filter(F.col("_blocs"), lambda b: b == wanted))

    return named.withColumns({name: tally(wanted) for wanted, name in columns.items()}).drop("_blocs")


def sum_parts(df: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Counts of the parts of one key added up."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])

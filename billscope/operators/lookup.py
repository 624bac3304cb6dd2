"""Look-ups: small fixed mappings, dimension joins, zero filling and keyword rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.operators.keyed import small_side
from billscope.operators.ordered import at_most


def mapped(value: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Case-sensitive look-up in an in-code mapping: no join at all. Long ones are better off in lookup()."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, value)
    return found if default is None else F.coalesce(found, F.lit(default))


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    on: Mapping[str, str],
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Left join to a dimension with one row per key; misses get the defaults.

    ``on`` maps a column of ``df`` to the dimension's key column.
    """
    names = [c for c in dimension.columns if c not in on.values()]
    side = dimension.select(*[F.col(d).alias(f"_k_{d}") for d in on.values()], *names)
    side = small_side(side)
    match = None
    for left, right in on.items():
        same = df[left] == side[f"_k_{right}"]
        match = same if match is None else match & same
    out = df.join(side, match, "left").drop(*[f"_k_{d}" for d in on.values()])
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def counts_with_zeros(dimension: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Every dimension row with its fact count; a category without facts gets 0."""
    counted = facts.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    return dimension.join(counted, key, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def month_of(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "MM")


def join_by_month(facts: DataFrame, moment: str, monthly: DataFrame, month: str) -> DataFrame:
    """Left join of facts to one row per month; month keys compare as dates."""
    keyed = facts.withColumn("_month", month_of(F.col(moment)))
    side = monthly.withColumn("_side_month", month_of(F.col(month))).drop(month)  # Spark broadcasts it by its size
    return keyed.join(side, keyed["_month"] == side["_side_month"], "left").drop("_side_month", "_month")


def keyword_category(
    text: Column,
    rules: Sequence[tuple[str, str]],
    exact: Mapping[str, str] | None = None,
    empty: str = "Indefinido",
    other: str = "Outro",
) -> Column:
    """Category of the first rule whose keyword occurs, then of an exact whole-text match."""
    lowered = F.lower(text)
    answer = F.lit(other)
    if exact:
        folded = {}
        for whole, category in exact.items():
            folded.setdefault(whole.lower(), category)
        answer = mapped(lowered, folded, other)
    for keyword, category in reversed(rules):
        answer = F.when(lowered.contains(keyword), F.lit(category)).otherwise(answer)
    return F.when(text.isNull(), F.lit(empty)).otherwise(answer)


def keyword_category_from(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    name: str,
    empty: str = "Indefinido",
    other: str = "Outro",
    limit: int = 10_000,
) -> DataFrame:
    """Same with a rule table (``priority, keyword, category``).

    The sorted rules travel as arrays of about ``limit`` rules, so each row is searched in
    place and no pair of row and rule is ever emitted; the first hit of all arrays counts.
    """
    parts = 1 if at_most(rules, limit) else -(-rules.count() // limit)
    shown = rules.select(F.struct("priority", F.lower("keyword").alias("keyword"), "category").alias("r"))
    lowered, firsts = F.lower(F.col(text)), []
    for part in range(parts):
        mine = shown.where(F.pmod(F.xxhash64("r"), F.lit(parts)) == part) if parts > 1 else shown
        df = df.withColumn(f"_rules{part}", mine.agg(F.sort_array(F.collect_list("r")).alias("r")).scalar())
        firsts.append(F.get(F.filter(F.col(f"_rules{part}"), lambda r: F.contains(lowered, r["keyword"])), F.lit(0)))
    first = firsts[0] if parts == 1 else F.array_min(F.array_compact(F.array(*firsts)))
    answer = F.when(F.col(text).isNull(), F.lit(empty)).otherwise(
        F.coalesce(first["category"], F.lit(other))
    )
    return df.withColumn(name, answer).drop(*[f"_rules{part}" for part in range(parts)])

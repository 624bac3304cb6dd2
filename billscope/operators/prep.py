"""Label codes, stratified splits, oversampling and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.operators.keyed import attach
from billscope.operators.neighbours import nearest_vectors
from billscope.operators.ordered import CHUNK, at_most, row_numbers, running_sums

SHORT_LIST = 10_000


def code_table(df: DataFrame, column: str) -> DataFrame:
    """Category and its 0-based code in code-point order.

    A checked, short list of categories is sorted as one array; a long one is ranked in
    chunks.
    """
    values = df.select(F.col(column).cast("string").alias("category")).where(
        F.col("category").isNotNull()
    ).distinct()
    if at_most(values, SHORT_LIST):
        listed = values.agg(F.sort_array(F.collect_list("category")).alias("all"))
        return listed.select(F.posexplode("all").alias("code", "category")).select("category", "code")
    ranked = row_numbers(values, [], ["category"], "_rank")
    return ranked.select("category", (F.col("_rank") - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """Codes from a fitted table; a category it lacks gets the next free code."""
    keyed = df.withColumn("_category", F.col(column).cast("string"))
    size = codes.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    known = codes.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    coded = attach(keyed, ["_category"], known)
    return coded.withColumn(output, F.coalesce("_code", size)).drop("_category", "_code")


def decode_labels(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """Categories of codes; an unknown code gives null."""
    names = codes.select(F.col("code").alias(column), F.col("category").alias(output))
    return attach(df, [column], names)


def _hash_order(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def _hash_ranked(df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Rank and size within the group under hash order; the hash's own prefix is the chunk."""
    hashed = df.withColumn("_hash", _hash_order(key, seed))
    hashed = hashed.withColumn(CHUNK, F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    one = F.lit(1).cast("long")
    return running_sums(hashed, groups, ["_hash", *key], {"_place": one}, totals=True).drop("_hash", CHUNK)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], seed: int = 42, test_share: float = 0.2, name: str = "is_test"
) -> DataFrame:
    """Mark exactly round(share * n) rows of every class as test rows, repeatably."""
    ranked = _hash_ranked(df, [label], key, seed)
    wanted = F.floor(F.col("_place_total") * F.lit(float(test_share)) + 0.5)
    return ranked.withColumn(name, F.col("_place") <= wanted).drop("_place", "_place_total")


def stratified_folds(
    df: DataFrame, label: str, key: Sequence[str], folds: int = 3, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Fold number per row, classes spread evenly over the folds."""
    ranked = _hash_ranked(df, [label], key, seed)
    return ranked.withColumn(name, F.pmod(F.col("_place"), F.lit(folds)).cast("int")).drop("_place", "_place_total")


def smote(
    df: DataFrame,
    label: str,
    key: str,
    features: Sequence[str],
    minority: object = 1,
    k: int = 5,
    seed: int = 42,
    whole: Sequence[str] = (),
) -> DataFrame:
    """Oversample the minority class to the size of the largest class.

    A new row lies between a minority row and one of its k nearest minority neighbours;
    rows, neighbours and positions are picked by hash, so a rerun gives the same rows.
    Copies of one point count as its neighbours at distance 0. Columns in ``whole`` are
    cut to whole numbers, as codes must be. Output: features, label, ``synthetic``, and
    the key of the row itself or of the row a new one starts from.
    """
    base = df.select(key, *[F.col(f).cast("double").alias(f) for f in features], label)
    few = base.where(F.col(label) == F.lit(minority)).withColumn("_v", F.array(*features))
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("n")).scalar()

    distinct = few.groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    near = nearest_vectors(distinct.select(F.col("_v").alias("v"), "n"), k)
    sized = near.join(distinct.select(F.col("_v").alias("v"), F.col("n").alias("_rows")), "v")
    own = F.array_repeat("v", F.least(F.col("_rows") - 1, F.lit(k)).cast("int"))
    rest = F.flatten(F.transform("near", lambda c: F.array_repeat(c["v"], F.least(c["n"], F.lit(k)).cast("int"))))
    slots = sized.select(F.col("v").alias("_v"), F.slice(F.concat(own, rest), 1, k).alias("_near"), "_rows")

    ranked = _hash_ranked(few.drop(label), [], [key], seed)
    placed = attach(ranked, ["_v"], slots)
    missing = F.col("_most") - F.col("_place_total")
    extra = F.when(F.col("_place") <= F.pmod(missing, F.col("_place_total")), 1).otherwise(0)
    copies = F.floor(missing / F.col("_place_total")) + extra
    placed = placed.withColumn("_most", most).withColumn("_copies", copies).where("_copies > 0")
    new = placed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))

    def pick(tag: str) -> Column:
        return F.xxhash64(F.col(key), F.col("_i"), F.lit(seed), F.lit(tag))

    chosen = F.get("_near", F.pmod(pick("neighbour"), F.greatest(F.size("_near"), F.lit(1))).cast("int"))
    share = F.pmod(pick("position"), F.lit(1_000_000)) / 1_000_000.0
    new = new.withColumn("_to", F.coalesce(chosen, F.col("_v"))).withColumn("_u", share)
    made = []
    for i, f in enumerate(features):
        value = F.get("_v", F.lit(i)) + F.col("_u") * (F.get("_to", F.lit(i)) - F.get("_v", F.lit(i)))
        made.append((value.cast("long").cast("double") if f in whole else value).alias(f))
    kind = base.schema[label].dataType
    new = new.select(key, *made, F.lit(minority).cast(kind).alias(label), F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(new)


def standardise(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation with the training set's mean and population deviation."""
    stats = train.agg(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns
    ]).select(F.struct(*columns).alias("_stats")).scalar()
    out = df.withColumn("_stats", stats)

    def scaled(c: str) -> Column:
        deviation = F.col(f"_stats.{c}.s")
        return (F.col(c) - F.col(f"_stats.{c}.m")) / F.when(deviation > 0, deviation).otherwise(1.0)

    return out.withColumns({c: scaled(c) for c in columns}).drop("_stats")

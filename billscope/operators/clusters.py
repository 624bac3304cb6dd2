"""K-means, its k sweep, cluster quality metrics and projections."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope.functions.vectors import squared_distance
from billscope.operators.keyed import attach
from billscope.operators.kmeans import Centres, kmeans_runs
from billscope.operators.ordered import CHUNK, at_most, running_sums, with_chunks

CLUSTER_LIMIT = 10_000
PARALLEL_STARTS = 8


def _array(df: DataFrame, column: str) -> Column:
    """The column as an array of doubles; a plain number becomes a one-element array."""
    kind = df.schema[column].dataType.typeName()
    value = F.col(column) if kind == "array" else F.array(F.col(column))
    return F.transform(value, lambda x: x.cast("double"))


def as_vector(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    """Array (or plain number) column as an MLlib vector."""
    return df.withColumn(output, array_to_vector(_array(df, column)))


def kmeans_best(
    df: DataFrame, k: int, features: str = "features", seed: int = 42, starts: int = 10,
    weight: str | None = None,
) -> KMeansModel:
    """The model of least cost over several seeded starts; ``weight`` counts equal points."""
    data = df.select(features, *([weight] if weight else [])).persist()
    extra = {"weightCol": weight} if weight else {}
    try:
        def fit(i: int) -> KMeansModel:
            return KMeans(k=k, featuresCol=features, predictionCol="cluster", seed=seed + i, **extra).fit(data)

        # starts are independent jobs; together they fill the cores that one leaves idle
        with ThreadPoolExecutor(min(starts, PARALLEL_STARTS)) as pool:
            models = list(pool.map(fit, range(starts)))
    finally:
        data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def k_sweep(
    df: DataFrame, value: str, ks: Sequence[int] = tuple(range(5, 51, 5)), seed: int = 42, starts: int = 10
) -> tuple[int, DataFrame, Centres]:
    """Best k by exact one-dimensional silhouette; ties go to the smaller k.

    Gives the best k, the table (k, silhouette) and the best run. Equal values are counted once; all
    runs then move together over the weighted points, and one pass scores the best run of every k.
    """
    points = df.dropna(subset=[value]).groupBy(value).agg(F.count(F.lit(1)).alias("_weight"))
    data = points.persist()
    try:
        runs = kmeans_runs(data, value, ks, starts, seed, "_weight")
        labels = [F.struct(F.lit(k).alias("k"), run.place(F.col(value)).alias("cluster")) for k, run in runs.items()]
        labelled = data.select(value, "_weight", F.explode(F.array(*labels)).alias("r")).select(value, "_weight", "r.*") if runs else None
        scores = {} if labelled is None else {
            r.k: r.silhouette for r in silhouette_1d(labelled, value, "cluster", weight="_weight", by="k").collect()
        }
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame([(k, scores.get(k)) for k in ks], "k int, silhouette double")
    best = max(ks, key=lambda k: (scores[k] if scores.get(k) is not None else float("-inf"), -k))
    return best, table, runs.get(best)


def nearest_centroid(
    rows: DataFrame, vector: str, centroids: DataFrame, cluster: str = "cluster",
    centroid: str = "centroid", limit: int = CLUSTER_LIMIT,
) -> DataFrame:
    """Closest centroid of each row, the smallest cluster number on a tie.

    The centroids travel as arrays of about ``limit``; no (row, centroid) pair leaves its row.
    """
    parts = 1 if at_most(centroids, limit) else -(-centroids.count() // limit)
    shown = centroids.select(F.struct(F.col(cluster).alias("c"), F.col(centroid).alias("v")).alias("m"))
    best = []
    for part in range(parts):
        mine = shown.where(F.pmod(F.xxhash64("m"), F.lit(parts)) == part) if parts > 1 else shown
        rows = rows.withColumn(f"_centroids{part}", mine.agg(F.sort_array(F.collect_list("m")).alias("a")).scalar())
        best.append(F.array_min(F.transform(
            F.col(f"_centroids{part}"),
            lambda m: F.struct(squared_distance(F.col(vector), m["v"]).alias("d"), m["c"].alias("c")),
        )))
    return (
        rows.withColumn("_best", best[0] if parts == 1 else F.array_min(F.array_compact(F.array(*best))))
        .withColumn(cluster, F.col("_best.c"))
        .withColumn("distance", F.sqrt("_best.d"))
        .drop(*[f"_centroids{part}" for part in range(parts)], "_best")
    )


def centroids_of(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Size, centroid and summed squared deviation of each cluster in one map-side pass."""
    vectors = as_vector(df.select(cluster, vector), vector, "_v")
    stats = vectors.groupBy(cluster).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")
    )
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, b: a + b)
    size = F.col("s.count")
    return stats.select(
        cluster, size.alias("n"), vector_to_array("s.mean").alias("centroid"),
        (F.when(size > 1, spread).otherwise(0.0) * (size - 1)).alias("within"),
    )


def silhouette_1d(
    df: DataFrame, value: str, cluster: str, chunks: int | None = None, weight: str | None = None, by: str | None = None
) -> DataFrame:
    """Exact mean silhouette (Euclidean) of one-dimensional points, of each ``by`` value if it is given.

    Equal points are counted first. The mean distance to a cluster that lies wholly on
    one side of a point is the gap to the cluster's mean; only for clusters that straddle
    the point - its own, and rarely others - running sums over the sorted values are
    needed, and those are chunked. No pair of points is ever formed.
    """
    points = df.dropna(subset=[value, cluster]).groupBy(
        (F.lit(0) if by is None else F.col(by)).alias("_of"), F.col(value).cast("double").alias("x"), F.col(cluster).alias("own")
    ).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    per_cluster = points.groupBy("_of", F.col("own").alias("c")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("m"),
        F.sum(F.col("x") * F.col("n")).alias("s"),
    )
    # one row for each clustering that is compared, with its clusters
    packed = per_cluster.groupBy("_of").agg(F.collect_list(F.struct("c", "lo", "hi", "m", "s")).alias("_all"))
    placed = points.join(F.broadcast(packed), "_of")
    x = F.col("x")

    def straddles(k: Column) -> Column:
        return (k["lo"] < x) & (x < k["hi"])

    others = F.filter("_all", lambda k: k["c"] != F.col("own"))
    outside = F.filter(others, lambda k: ~straddles(k))
    gap = F.array_min(F.transform(outside, lambda k: F.abs(k["s"] / k["m"] - x)))
    probed = F.filter("_all", lambda k: (k["c"] == F.col("own")) | straddles(k))
    probes = placed.select("_of", "x", "own", "n", gap.alias("gap"), F.explode(F.transform(probed, lambda k: k["c"])).alias("c"))

    nodes = probes.groupBy("_of", "c", "x").agg(F.sum(F.when(F.col("c") == F.col("own"), F.col("n")).otherwise(0)).alias("w"))
    nodes = running_sums(
        with_chunks(nodes, ["x"], chunks, df, keep=True), ["_of", "c"], ["x"],
        {"nl": F.col("w"), "sl": F.col("w") * F.col("x")}, totals=True,
    ).drop(CHUNK)
    reach = (
        x * F.col("nl") - F.col("sl") + (F.col("sl_total") - F.col("sl")) - x * (F.col("nl_total") - F.col("nl"))
    )
    nodes = nodes.select(
        F.col("_of").alias("_o"), F.col("c").alias("_c"), F.col("x").alias("_x"), reach.alias("d"), F.col("nl_total").alias("m")
    )
    met = probes.join(nodes, (probes["_of"] == nodes["_o"]) & (probes["c"] == nodes["_c"]) & (probes["x"] == nodes["_x"]))
    own = F.col("c") == F.col("own")
    scored = met.groupBy("_of", "x", "own").agg(
        F.max("n").alias("n"),
        F.max(F.when(own, F.col("m"))).alias("m"),
        F.max(F.when(own, F.try_divide(F.col("d"), F.col("m") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("m"))).alias("near"),
        F.min("gap").alias("gap"),
    )
    b = F.least("near", "gap")
    score = F.when(F.col("m") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - F.col("a"), F.greatest(b, F.col("a"))), F.lit(0.0))
    )
    mean = (F.sum(score * F.col("n")) / F.sum("n")).alias("silhouette")
    return scored.agg(mean) if by is None else scored.groupBy(F.col("_of").alias(by)).agg(mean)


def silhouette_squared(df: DataFrame, features: str, cluster: str) -> float:
    """MLlib's silhouette (squared distances, any dimension): the scalable stand-in for n-D."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(df)


def davies_bouldin(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij."""
    rows = df.select(cluster, _array(df, vector).alias("_v"))
    stats = centroids_of(df, vector, cluster).select(cluster, F.col("n").alias("_rows"), "centroid")
    near = attach(rows, [cluster], stats)
    spreads = near.groupBy(cluster).agg(
        F.avg(F.sqrt(squared_distance(F.col("_v"), F.col("centroid")))).alias("spread"),
        F.first("centroid").alias("centroid"),
    )
    packed = spreads.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "spread", "centroid")).alias("a")).scalar()
    others = F.filter("_all", lambda o: o["c"] != F.col(cluster))
    ratios = F.transform(
        others,
        lambda o: F.try_divide(
            F.col("spread") + o["spread"], F.sqrt(squared_distance(F.col("centroid"), o["centroid"]))
        ),
    )
    worst = spreads.withColumn("_all", packed).select(F.array_max(ratios).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(between / (k-1)) / (within / (n-k)); all from the per-cluster summaries."""
    stats = centroids_of(df, vector, cluster)
    # the grand mean is summed per dimension; clusters never meet in one row
    each = stats.select("n", F.posexplode("centroid").alias("at", "x")).groupBy("at").agg(
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")
    )
    middle = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda e: e["m"]).alias("v")).scalar()
    done = stats.withColumn("_middle", middle).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("within"),
        F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("_middle"))).alias("between"),
    )
    value = F.try_divide(
        F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))
    )
    return done.select(F.coalesce(value, F.lit(1.0)).alias("calinski_harabasz"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _pairs(n: Column) -> Column:
    count = n.cast("double")
    return count * (count - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    cells = contingency(df, a, b)
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("s")).scalar()
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("s")).scalar()
    rows = both.withColumn("l", left).withColumn("r", right)
    expected = F.col("l") * F.col("r") / _pairs(F.col("n"))
    value = F.try_divide(F.col("s") - expected, (F.col("l") + F.col("r")) / 2 - expected)
    return rows.select(F.coalesce(value, F.lit(1.0)).alias("ari"))


def normalized_mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of both entropies."""
    cells = contingency(df, a, b)
    total = cells.agg(F.sum("n").alias("n")).scalar()

    def entropy(parts: DataFrame) -> Column:
        share = F.col("n") / F.col("_t")
        return parts.withColumn("_t", total).agg((-F.sum(share * F.log(share))).alias("h")).scalar()

    h_a = entropy(cells.groupBy("a").agg(F.sum("n").alias("n")))
    h_b = entropy(cells.groupBy("b").agg(F.sum("n").alias("n")))
    h_ab = entropy(cells)
    one = df.sparkSession.range(1).select(h_a.alias("ha"), h_b.alias("hb"), h_ab.alias("hab"))
    value = F.try_divide(F.col("ha") + F.col("hb") - F.col("hab"), (F.col("ha") + F.col("hb")) / 2)
    return one.select(F.coalesce(value, F.lit(1.0)).alias("nmi"))


def metric_row(
    df: DataFrame, value: str, cluster: str, truth: str, best_k: int | None = None
) -> DataFrame:
    """One row with all quality metrics of a one-dimensional clustering."""
    parts = {
        "silhouette": silhouette_1d(df, value, cluster),
        "davies_bouldin": davies_bouldin(df, value, cluster),
        "calinski_harabasz": calinski_harabasz(df, value, cluster),
        "ari": adjusted_rand(df, truth, cluster),
        "nmi": normalized_mutual_info(df, truth, cluster),
    }
    one = df.sparkSession.range(1).select(*[p.scalar().alias(n) for n, p in parts.items()])
    return one.withColumn("best_k", F.lit(best_k).cast("int"))


def project_2d(df: DataFrame, features: str, x: str = "x", y: str = "y") -> DataFrame:
    """First two principal components of a vector column."""
    model = PCA(k=2, inputCol=features, outputCol="_pc").fit(df)
    out = model.transform(df).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({x: F.get("_pc", F.lit(0)), y: F.get("_pc", F.lit(1))}).drop("_pc")

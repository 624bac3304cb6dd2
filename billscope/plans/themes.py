"""Summaries and themes -> similarity -> clusters -> metrics and dominant themes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.functions import text
from billscope.operators import clusters, embed, latent, rows, shares, sparse_kmeans, tfidf
from billscope.shared import settle

# Fixed value: themes that start so come from a failed fetch.
ERROR_PREFIX = "Erro"


@dataclass
class ThemeClusters:
    best_k: int
    scores: DataFrame
    metrics: DataFrame
    summary: DataFrame
    rollup: DataFrame
    assignment: DataFrame


def themed_rows(bills: DataFrame, order: Sequence[str], summary: str = "ementa_detalhada", themes: str = "temas") -> DataFrame:
    """Row id, sub-texts, theme tokens and main theme of the complete rows."""
    numbered = rows.add_row_id(bills.select(*dict.fromkeys([*order, summary, themes])), order)
    split = rows.drop_nulls(numbered, [summary, themes]).withColumns({
        "sub_ementas": text.split_trim(F.col(summary)), "tokens_temas": text.split_trim(F.col(themes)),
    })
    main = split.withColumn("tema_principal", text.first_or(F.col("tokens_temas")))
    return rows.reject_prefix(main, "tema_principal", ERROR_PREFIX)


def encoded_by(df: DataFrame, text: str, encoder: embed.Encoder | latent.Latent, output: str) -> DataFrame:
    """Vectors of a text or of an array of texts, from a user's model or one learned from a corpus."""
    if isinstance(encoder, latent.Latent):
        return encoder.encode(df, text, output)
    return embed.encode_with(df, text, encoder, output)


def with_similarity(themed: DataFrame, encoder: embed.Encoder | latent.Latent | None = None) -> DataFrame:
    """Length-weighted best similarity; without an encoder letter profiles are compared."""
    if encoder is None:
        parts, themes = embed.letter_profiles(F.col("sub_ementas")), embed.letter_profiles(F.col("tokens_temas"))
        return embed.weighted_best_similarity(themed, "sub_ementas", parts, themes, "similaridade")
    encoded = encoded_by(themed, "sub_ementas", encoder, "_parts")
    encoded = encoded_by(encoded, "tokens_temas", encoder, "_themes")
    scored = embed.weighted_best_similarity(
        encoded, "sub_ementas", F.col("_parts"), F.col("_themes"), "similaridade"
    )
    return scored.drop("_parts", "_themes")


def theme_clusters(
    themed: DataFrame, encoder: embed.Encoder | latent.Latent | None = None, ks: Sequence[int] = tuple(range(5, 51, 5)), starts: int = 10
) -> ThemeClusters:
    """The whole clustering chain; the scored rows are written down once and read from there."""
    scored = settle(with_similarity(themed, encoder))
    best, scores, model = clusters.k_sweep(scored, "similaridade", ks=ks, starts=starts)
    labelled = scored.withColumn("cluster", model.place(F.col("similaridade")))
    tokens = labelled.select("cluster", "ID", F.posexplode("tokens_temas").alias("pos", "token"))
    summary = shares.mode_with_share(tokens, "cluster", "token", ["ID", "pos"])
    assigned = shares.assign_theme(
        labelled.select("ID", "cluster", "ementa_detalhada"), summary.select("cluster", "theme")
    )
    return ThemeClusters(
        best_k=best,
        scores=scores,
        metrics=clusters.metric_row(labelled, "similaridade", "cluster", "tema_principal", best),
        summary=summary,
        rollup=shares.theme_rollup(summary),
        assignment=assigned,
    )


def tfidf_clusters(
    bills: DataFrame, key: str = "id", summary: str = "ementa", k: int = 5, starts: int = 10,
    language: str = "portuguese", min_df: int = 3, max_df: float = 0.8,
) -> DataFrame:
    """Clusters of TF-IDF vectors with a two-dimensional place for each row.

    The weights stay a long table; neither the vocabulary nor a centre is on the driver.
    The place comes from hashed n-grams, whose fixed width suits principal components
    however large the vocabulary is.
    """
    filled = rows.fill_nulls(bills, {summary: ""})
    taken = settle(filled.withColumn("_row", F.monotonically_increasing_id()))
    weights = tfidf.tfidf(taken, "_row", summary, words=tfidf.stop_words(language), min_df=min_df, max_df=max_df)
    placed = sparse_kmeans.kmeans_sparse(weights, taken, k, "_row", starts=starts)
    return place_rows(taken.join(placed, "_row").drop("_row"), summary)


def sentence_clusters(
    bills: DataFrame, encoder: embed.Encoder | latent.Latent | None = None, summary: str = "ementa", k: int = 5, starts: int = 10
) -> DataFrame:
    """The same on sentence vectors of a user's or a learned model, or hashed n-grams without one."""
    filled = rows.fill_nulls(bills, {summary: ""})
    encoded = (
        embed.encode(filled, summary, "_vector") if encoder is None
        else encoded_by(filled, summary, encoder, "_vector")
    )
    vectors = clusters.as_vector(encoded, "_vector")
    labelled = clusters.kmeans_best(vectors, k, starts=starts).transform(vectors)
    return clusters.project_2d(labelled, "features").drop("_vector", "features")


def place_rows(df: DataFrame, summary: str, size: int = 256) -> DataFrame:
    """Add x and y: the first two principal components of hashed n-grams."""
    encoded = clusters.as_vector(embed.encode(df, summary, "_vector", size), "_vector", "_features")
    return clusters.project_2d(encoded, "_features").drop("_vector", "_features")


def cluster_samples(clustered: DataFrame, key: str = "id", n: int = 3) -> DataFrame:
    """First rows of each cluster."""
    return shares.head_per_group(clustered, "cluster", [key], n)

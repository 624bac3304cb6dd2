"""Whole chains on documents: texts and their tags to clusters, metrics and dominant themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.plans import themes
from billscope.queries.registry import query, texts


def tagged(spark, sf_dir) -> DataFrame:
    """Documents with their language and source as themes."""
    return texts(spark, sf_dir, "lang", "source").select(
        F.col("doc_id").alias("id"), F.col("text").alias("ementa_detalhada"), F.concat_ws(", ", "lang", "source").alias("temas")
    )


@query("chain_themed_rows", """
select doc_id as id, lang as tema_principal, 2::int as n_temas
from documents where text is not null and text <> '' and starts_with(lang, 'Erro') = false
""")
def chain_themed_rows(spark, sf_dir):
    themed = themes.themed_rows(tagged(spark, sf_dir), ["id"])
    return themed.select("id", "tema_principal", F.size("tokens_temas").alias("n_temas"))


@query("chain_theme_clusters")
def chain_theme_clusters(spark, sf_dir):
    """Metrics of the best number of clusters, derived from the sweep over all k."""
    themed = themes.themed_rows(tagged(spark, sf_dir), ["id"])
    return themes.theme_clusters(themed).metrics


@query("chain_tfidf_clusters")
def chain_tfidf_clusters(spark, sf_dir):
    rows = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("ementa"))
    return themes.tfidf_clusters(rows).select("id", "cluster", "x", "y")

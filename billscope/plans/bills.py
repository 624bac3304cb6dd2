"""Landed listing and resources -> bills -> derived features -> training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope import fixed
from billscope.functions import dates
from billscope.operators import enrich, lookup, rows
from billscope.sources import landed

# The election year, the years of the first government and both labels.
ELECTION_YEARS = (2022,)
FIRST_GOVERNMENT_YEARS = (2021, 2022)
FIRST_GOVERNMENT, SECOND_GOVERNMENT = "direita", "esquerda"

# Authors whose bills are left out of training, and the columns kept.
EXCLUDED_AUTHORS = "Senado Federal"
UNKNOWN_STATE = "?"
TRAINING_COLUMNS = (
    "ano", "data_status", "regiao", "dias_tramitacao", "tema_dominante", "bloco_partidario",
    "autoria_coletiva", "aprovado", "ano_eleitoral", "governo",
)


def bill_table(
    pages: DataFrame,
    authors: DataFrame,
    author_details: DataFrame,
    movements: DataFrame,
    details: DataFrame,
    themes: DataFrame,
    cap: int | None = None,
) -> DataFrame:
    """Listed bills with everything the landed resources know about them."""
    bills = landed.page_items(landed.usable_pages(pages, cap=cap))
    labelled = enrich.author_labels(enrich.flat_authors(authors), author_details)
    flat_themes = themes.select("id_bill", F.posexplode("dados").alias("seq", "t")).select(
        "id_bill", "seq", F.col("t.tema").alias("tema")
    )
    out = enrich.author_texts(bills, labelled)
    out = enrich.first_and_last_movement(out, enrich.flat_movements(movements))
    return enrich.theme_texts(enrich.bill_detail(out, details), flat_themes)


def bill_features(bills: DataFrame) -> DataFrame:
    """All derived columns. The presentation date is cast strictly: a bad one fails the job."""
    dated = bills.withColumn("data_apresentacao", F.col("data_apresentacao").cast("date"))
    day = F.col("data_apresentacao")
    flagged = dated.withColumns({
        "ano_eleitoral": dates.year_flag(day, ELECTION_YEARS),
        "governo": dates.period_label(day, FIRST_GOVERNMENT_YEARS, FIRST_GOVERNMENT, SECOND_GOVERNMENT),
    })
    return enrich.enrich(flagged)


def with_composition(features: DataFrame, composition: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Bloc counts of the status month; the ``MMyyyy`` text is read back as a date."""
    dated = features.withColumn("_status_month", F.to_date(
        F.when(F.col("data_status").rlike(r"^(0[1-9]|1[0-2])\d{4}$"), F.col("data_status")), "MMyyyy"
    ))
    monthly = composition.select("data", *counts)
    return lookup.join_by_month(dated, "_status_month", monthly, "data").drop("_status_month")


def training_rows(features: DataFrame, columns: Sequence[str] = TRAINING_COLUMNS) -> DataFrame:
    """Finished bills with known state, complete in the chosen columns; ``aprovado`` as 0/1."""
    kept = rows.reject_prefix(features, "autores", EXCLUDED_AUTHORS)
    kept = rows.update_where(kept, F.col("aprovado"), "finalizado", True)
    kept = rows.not_equal(kept.where("finalizado"), "uf_principal", UNKNOWN_STATE)
    theme = lookup.keyword_category(F.col("temas"), fixed.KEYWORD_RULES, fixed.CATEGORY_OF_THEME)
    kept = kept.withColumn("tema_dominante", theme)
    key = [c for c in ("id",) if c not in columns]
    kept = rows.drop_nulls(kept.select(*key, *columns), list(columns))
    return kept.withColumn("aprovado", F.col("aprovado").cast("int"))

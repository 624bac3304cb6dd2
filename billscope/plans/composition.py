"""Member histories -> tenure and party intervals -> who sat when -> bloc head-counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope import fixed
from billscope.functions import dates
from billscope.operators import intervals, lookup, rows, stats
from billscope.shared import settle
from billscope.sources import landed

# What opens and what closes a tenure, and the head-count columns.
OPENING_WORD = "Posse"
CLOSING_STATUS = "Fim de Mandato"
BLOC_COLUMNS = {"Esquerda": "qtd_esquerda", "Direita": "qtd_direita", "Centrão": "qtd_centrao"}
BLOC_NAMES = {"qtd_esquerda": "Left", "qtd_centrao": "Big Center", "qtd_direita": "Right"}
ORDER = ["ts", "pos"]


def timed_events(history: DataFrame) -> DataFrame:
    """Events with a readable time; the others are skipped, not fatal."""
    events = landed.history_events(history).withColumn("ts", dates.iso_minute(F.col("dataHora")))
    return events.where(F.col("ts").isNotNull())


def _named(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Name of the member's earliest event on each span."""
    names = events.groupBy("id").agg(F.min_by(F.struct("nome"), F.struct(*ORDER))["nome"].alias("nome"))
    return spans.join(names, "id")


def tenure(history: DataFrame, as_of: Column, chunks: int | None = None) -> DataFrame:
    events = timed_events(history)
    spans = intervals.open_close_periods(
        events.where(F.col("situacao").isNotNull()), "id", ORDER, F.col("ts").cast("date"),
        opens=F.col("descricaoStatus").contains(OPENING_WORD),
        closes=F.col("situacao") == CLOSING_STATUS, as_of=as_of, chunks=chunks,
    )
    return _named(events, spans).select("id", "nome", "data_entrada", "data_saida")


def affiliation(history: DataFrame, as_of: Column, chunks: int | None = None) -> DataFrame:
    events = timed_events(history)
    spans = intervals.value_runs(
        events, "id", ORDER, F.col("ts").cast("date"), "siglaPartido", as_of, chunks=chunks, place="ordem"
    )
    return _named(events, spans).select(
        "id", "nome", F.col("siglaPartido").alias("sigla_partido"), "data_entrada_partido", "data_saida_partido", "ordem"
    )


def members_by_date(tenures: DataFrame, affiliations: DataFrame, days: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Per day the members in office with their party on that day.

    Of several parties on one day the first in the stored order of events counts.
    The seats are written down first: listing them in parts reads them twice.
    """
    active = intervals.active_on(tenures, days)
    parties = intervals.first_match_on(
        active.select("id", "data"), affiliations, "id", "sigla_partido", order=["ordem"] if "ordem" in affiliations.columns else ()
    )
    member = F.struct("id", F.col("sigla_partido").alias("partido"))
    return intervals.collect_members(settle(parties), ["data"], member, F.col("id"), "partidos", part_rows)


def composition(members: DataFrame, blocs: Mapping[str, str] = fixed.BLOC_OF_PARTY) -> DataFrame:
    """Head-count per bloc and day."""
    counted = intervals.bloc_counts(members, "partidos", "partido", blocs, BLOC_COLUMNS)
    return intervals.sum_parts(counted, ["data"], list(BLOC_COLUMNS.values()))


def bloc_shares(counts: DataFrame) -> DataFrame:
    """Long table of bloc percentages per day."""
    columns = list(BLOC_NAMES)
    shares = stats.row_shares(counts.select("data", *columns), columns)
    tall = rows.long_form(shares.drop("total"), ["data"], columns, "bloco_partidario", "percentual_deputados")
    return tall.withColumn("bloco_partidario", lookup.mapped(F.col("bloco_partidario"), BLOC_NAMES))

"""Bills joined to their authors, movements, detail record and themes; search; optional fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billscope import fixed
from billscope.functions import dates, text
from billscope.operators.keyed import attach, attach_aggregates
from billscope.operators.lookup import keyword_category, mapped

# Texts that stand for missing parts.
NO_AUTHOR = "Sem autor registrado"
NO_AUTHOR_TYPE = "Não especificado"
NO_MOVEMENT = "Sem tramitação"
NO_STATUS = "Indefinido"
NO_THEME = "Sem temas"


def flat_authors(authors: DataFrame) -> DataFrame:
    """Author resources to rows ``(id_bill, seq, uri, nome, tipo)``."""
    return authors.select("id_bill", F.posexplode("dados").alias("seq", "a")).select(
        "id_bill", "seq", F.col("a.uri").alias("uri"), F.col("a.nome").alias("nome"),
        F.col("a.tipo").alias("tipo"),
    )


def author_labels(
    rows: DataFrame, details: DataFrame, uri: str = "uri", name: str = "nome", label: str = "label"
) -> DataFrame:
    """Add ``name (party-state)`` labels, unknown parts as ``?``.

    ``details`` holds ``uri`` and ``ultimoStatus``. One author may sign a large share of
    all bills, so the detail comes through the skew-safe attach.
    """
    known = details.select(
        F.col("uri").alias(uri),
        F.col("ultimoStatus.siglaPartido").alias("_party"),
        F.col("ultimoStatus.siglaUf").alias("_state"),
    )
    named = attach(rows, [uri], known)
    return named.withColumn(
        label, text.author_label(F.col(name), F.col("_party"), F.col("_state"))
    ).drop("_party", "_state")


def author_texts(
    bills: DataFrame,
    authors: DataFrame,
    bill: str = "id",
    author_bill: str = "id_bill",
    order: Sequence[str] = ("seq",),
    label: str = "label",
    kind: str = "tipo",
) -> DataFrame:
    """Add ``autores`` (labels in order) and ``tipo_autor`` (distinct types, sorted)."""
    entry = F.when(F.col(label).isNotNull(), F.struct(*order, F.col(label).alias("_label")))
    named_kind = F.when(F.col(kind) != "", F.col(kind))
    folded = authors.groupBy(F.col(author_bill).alias("_bill")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_label"]), ", ").alias("_labels"),
        F.array_join(F.sort_array(F.collect_set(named_kind)), ", ").alias("_kinds"),
    )
    return bills.join(folded, bills[bill] == folded["_bill"], "left").select(
        *bills.columns,
        F.coalesce(F.nullif("_labels", F.lit("")), F.lit(NO_AUTHOR)).alias("autores"),
        F.coalesce(F.nullif("_kinds", F.lit("")), F.lit(NO_AUTHOR_TYPE)).alias("tipo_autor"),
    )


def author_names(
    bills: DataFrame, authors: DataFrame, bill: str = "id", author_bill: str = "id_bill",
    order: Sequence[str] = ("seq",), name: str = "nome",
) -> DataFrame:
    """Names-only variant: add ``autores`` with the joined names."""
    plain = authors.select(author_bill, *order, F.col(name).alias("_name"), F.lit("").alias("_kind"))
    return author_texts(bills, plain, bill, author_bill, order, "_name", "_kind").drop("tipo_autor")


def flat_movements(movements: DataFrame) -> DataFrame:
    rows = movements.select("id_bill", F.posexplode("dados").alias("seq", "m"))
    return rows.select(
        "id_bill", "seq", F.col("m.orgao.nome").alias("orgao"),
        F.col("m.descricaoTramitacao").alias("descricao"), F.col("m.dataHora").alias("data_hora"),
    )


def first_and_last_movement(
    bills: DataFrame,
    movements: DataFrame,
    bill: str = "id",
    movement_bill: str = "id_bill",
    order: Sequence[str] = ("seq",),
    organ: str = "orgao",
    description: str = "descricao",
    moment: str = "data_hora",
) -> DataFrame:
    """First and last movement by stored order (not by date), with sentinels for none."""
    place = F.struct(*order)
    blank = F.lit("")
    step = F.struct(
        F.coalesce(F.col(organ), blank).alias("orgao"),
        F.coalesce(F.col(description), blank).alias("descricao"),
        F.coalesce(dates.day_text(F.col(moment)), blank).alias("data"),
    )
    ends = movements.groupBy(F.col(movement_bill).alias("_bill")).agg(
        F.min_by(step, place).alias("_first"), F.max_by(step, place).alias("_last")
    )

    def part(side: str, field: str, missing: str = "") -> Column:
        return F.coalesce(F.col(f"{side}.{field}"), F.lit(missing))

    return bills.join(ends, bills[bill] == ends["_bill"], "left").select(
        *bills.columns,
        part("_first", "orgao", NO_MOVEMENT).alias("orgao_inicial"),
        part("_first", "descricao").alias("descricao_inicial"),
        part("_first", "data").alias("data_apresentacao"),
        part("_last", "orgao").alias("orgao_ultimo"),
        part("_last", "descricao").alias("descricao_ultimo"),
        part("_last", "data").alias("data_ultimo"),
    )


def bill_detail(bills: DataFrame, detail: DataFrame, bill: str = "id") -> DataFrame:
    """Status, status month and detailed summary from one join to the detail record."""
    side = detail.select(
        F.col("id_bill").alias("_bill"),
        F.col("statusProposicao.descricaoSituacao").alias("_status"),
        F.col("statusProposicao.dataHora").alias("_moment"),
        F.col("ementaDetalhada").alias("ementa_detalhada"),
    )
    return bills.join(side, bills[bill] == side["_bill"], "left").select(
        *bills.columns,
        text.nested_or(F.col("_status"), NO_STATUS).alias("status_atual"),
        dates.month_key(F.col("_moment")).alias("data_status"),
        "ementa_detalhada",
    )


def theme_texts(
    bills: DataFrame, themes: DataFrame, bill: str = "id", theme_bill: str = "id_bill",
    order: Sequence[str] = ("seq",), theme: str = "tema",
) -> DataFrame:
    """Add ``temas``: the bill's themes in order as one text."""
    entry = F.when(F.col(theme).isNotNull(), F.struct(*order, F.col(theme).alias("_theme")))
    folded = themes.groupBy(F.col(theme_bill).alias("_bill")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_theme"]), ", ").alias("_themes")
    )
    return bills.join(folded, bills[bill] == folded["_bill"], "left").select(
        *bills.columns, F.coalesce(F.nullif("_themes", F.lit("")), F.lit(NO_THEME)).alias("temas")
    )


def search(
    bills: DataFrame,
    types: Sequence[str],
    years: Sequence[int],
    states: Sequence[str] = (),
    parties: Sequence[str] = (),
    type_column: str = "tipo",
    year_column: str = "ano",
    state: Column | None = None,
    party: Column | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Bills of the given types and years, optionally of first-author states and parties.

    An empty state or party list means no such filter. All conditions go into one
    filter, so those on stored columns reach the scan.
    """
    if not types or not years:
        raise ValueError("choose at least one type and one year")
    state = text.first_state(F.col("autores")) if state is None else state
    party = text.first_party(F.col("autores")) if party is None else party

    def among(value: Column, wanted: Sequence[str]) -> Column:
        if ignore_case:
            return F.lower(value).isin(*[w.lower() for w in wanted])
        return value.isin(*wanted)

    condition = F.col(type_column).isin(*types) & F.col(year_column).isin(*years)
    if states:
        condition &= among(state, states)
    if parties:
        condition &= among(party, parties)
    return bills.where(condition)


FIELD_NEEDS = {"regiao": "uf_principal", "bloco_partidario": "partido_principal"}


def field_columns(
    regions: Mapping[str, str] = fixed.REGION_OF_STATE, blocs: Mapping[str, str] = fixed.BLOC_OF_PARTY
) -> dict[str, Column]:
    """The derived columns that depend on the row alone."""
    start, end = F.col("data_apresentacao"), F.col("data_ultimo")
    return {
        "aprovado": text.any_term(F.col("status_atual"), fixed.APPROVED_TERMS),
        "finalizado": text.any_term(F.col("status_atual"), fixed.FINISHED_TERMS),
        "dias_tramitacao": dates.days_between(start, end),
        "tema_dominante": keyword_category(F.col("temas"), fixed.KEYWORD_RULES),
        "uf_principal": text.first_state(F.col("autores")),
        "regiao": mapped(F.col("uf_principal"), regions, "Indefinida"),
        "partido_principal": text.first_party(F.col("autores")),
        "bloco_partidario": mapped(F.col("partido_principal"), blocs, "Outros"),
        "autoria_coletiva": text.has_comma(F.col("autores")),
        "qtd_tramitacoes": dates.step_count(start, end),
    }


DUPLICATE_FIELD = "apensada_ou_duplicada"
ALL_FIELDS = [
    "aprovado", "finalizado", "dias_tramitacao", "tema_dominante", "uf_principal", "regiao",
    "partido_principal", "bloco_partidario", "apensada_ou_duplicada", "autoria_coletiva", "qtd_tramitacoes",
]


def enrich(
    bills: DataFrame,
    fields: Sequence[str] = tuple(ALL_FIELDS),
    regions: Mapping[str, str] = fixed.REGION_OF_STATE,
    blocs: Mapping[str, str] = fixed.BLOC_OF_PARTY,
    overrides: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add only the requested derived columns; what they depend on is worked out on the way."""
    unknown = set(fields) - set(ALL_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    known = {**field_columns(regions, blocs), **(overrides or {})}
    helpers = [FIELD_NEEDS[f] for f in fields if f in FIELD_NEEDS and FIELD_NEEDS[f] not in fields]
    helpers = [h for h in dict.fromkeys(helpers) if h not in bills.columns]
    row_fields = [f for f in [*helpers, *fields] if f != DUPLICATE_FIELD]
    out = bills
    first = {f: known[f] for f in row_fields if f not in FIELD_NEEDS}
    second = {f: known[f] for f in row_fields if f in FIELD_NEEDS}
    if first:
        out = out.withColumns(first)
    if second:
        out = out.withColumns(second)
    if DUPLICATE_FIELD in fields:
        out = duplicate_flag(out, "ementa", DUPLICATE_FIELD)
    return out.select(*bills.columns, *[f for f in fields if f not in bills.columns])


def duplicate_flag(df: DataFrame, column: str, name: str) -> DataFrame:
    """True on every row whose value occurs more than once; nulls equal each other.

    Texts are compared by their 256-bit digest, so whole texts are never shuffled as keys.
    """
    keyed = df.withColumn("_digest", F.sha2(F.col(column).cast("string"), 256))
    counted = attach_aggregates(keyed, ["_digest"], F.count(F.lit(1)).alias("_copies"))
    return counted.withColumn(name, F.col("_copies") > 1).drop("_digest", "_copies")

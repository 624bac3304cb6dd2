"""Null, tie and boundary rules of filters, scalars, look-ups and enrichment."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from billscope import fixed
from billscope.functions import dates, text
from billscope.operators import enrich, lookup, rows
from billscope.sources import landed, tables


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


LABELS = ["Ana (PT-SP), Bob (PL-RJ)", "Senado Federal", "X (?-?)", None, "Maria Rosa-Lima (PSB-PE)", "Sem autor registrado"]


def test_first_state_and_party(spark):
    assert column(spark, LABELS, text.first_state) == ["SP", None, "?", None, "PE", None]
    assert column(spark, LABELS, text.first_party) == ["PT", None, "?", None, "PSB", None]
    joined = column(spark, LABELS, lambda c: text.joined_or_null(text.all_parties(c)))
    assert joined == ["PT, PL", None, "?", None, "PSB", None]


def test_split_trim_and_first(spark):
    values = [" a , b;;c ", "", " , ; ", None]
    assert column(spark, values, text.split_trim) == [["a", "b", "c"], [], [], None]
    assert column(spark, values, lambda c: text.first_or(text.split_trim(c))) == ["a"] + ["Desconhecido"] * 3


def test_prefix_and_null_safe_not_equal(spark):
    frame = spark.createDataFrame([("Erro: x",), ("?",), (None,), ("ok",)], "c string")
    assert {r.c for r in rows.reject_prefix(frame, "c", "Erro").collect()} == {"?", None, "ok"}
    assert {r.c for r in rows.not_equal(frame, "c", "?").collect()} == {"Erro: x", None, "ok"}
    assert {r.c for r in rows.not_equal(frame, "c", "?", drop_null=True).collect()} == {"Erro: x", "ok"}
    inside, outside = rows.split_by_membership(frame, "c", ["ok", "?"])
    assert inside.count() == 2 and outside.count() == 2
    table = spark.createDataFrame([("ok",), ("?",), (None,)], "v string")
    inside, outside = rows.split_by_membership(frame, "c", table)
    assert inside.count() == 2 and {r.c for r in outside.collect()} == {"Erro: x", None}


def test_row_id_counts_before_nulls_are_dropped(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "c string, k int")
    got = rows.drop_nulls(rows.add_row_id(frame, ["k"]), ["c"])
    assert sorted((r.ID, r.c) for r in got.collect()) == [(0, "a"), (2, "b")]


def test_outcome_filters_and_update(spark):
    frame = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, True), (4, False, None)], "i int, a boolean, f boolean")
    assert [r.i for r in rows.approved_rows(frame, F.col("a")).collect()] == [1]
    assert [r.i for r in rows.rejected_rows(frame, F.col("a"), F.col("f")).collect()] == [2]
    updated = rows.update_where(frame, F.col("a"), "f", True)
    assert {r.i: r.f for r in updated.collect()} == {1: True, 2: True, 3: True, 4: None}


def test_status_terms(spark):
    values = ["ARQUIVADA", "Aguardando Sanção", None, "Transformado em Lei", "Em análise", "Devolvida ao(à) autor(a)"]
    assert column(spark, values, lambda c: text.any_term(c, fixed.FINISHED_TERMS)) == [True, True, False, False, False, True]
    assert column(spark, values, lambda c: text.any_term(c, fixed.APPROVED_TERMS)) == [False, True, False, True, False, False]


def test_dates(spark):
    frame = spark.createDataFrame([("2024-01-01", "2024-01-31"), ("Erro", "2024-01-01"), ("2024-02-02", "2024-02-02"), (None, None)], "a string, b string")
    got = frame.select(
        dates.days_between(F.col("a"), F.col("b")).alias("d"), dates.step_count(F.col("a"), F.col("b")).alias("n")
    ).collect()
    assert [(r.d, r.n) for r in got] == [(30, 2), (None, 2), (0, 1), (None, 2)]
    days = [date(2022, 5, 1), date(2021, 1, 1), None, date(2023, 1, 1)]
    assert column(spark, days, dates.year_flag, "date") == [1, 0, 0, 0]
    label = lambda c: dates.period_label(c, [2021, 2022], "direita", "esquerda")
    assert column(spark, days, label, "date") == ["direita", "direita", "esquerda", "esquerda"]
    assert column(spark, ["2021-03-05T10:00", None], dates.month_key) == ["032021", "Data não encontrada"]
    months = spark.range(1).select(F.explode(dates.month_days(
        F.lit("2024-11-20").cast("date"), F.lit("2025-03-01").cast("date"), 15, F.lit("2025-02-14").cast("date")
    )).alias("d"))
    assert [str(r.d) for r in months.collect()] == ["2024-11-15", "2024-12-15", "2025-01-15"]


def test_small_scalars(spark):
    assert column(spark, [" PT* ", "*PL", None], text.clean_symbol) == ["PT", "PL", None]
    assert column(spark, [1.005, 2.5, 12.344999], text.round2, "double") == [1.0, 2.5, 12.34]
    cells = ["[{'id': 1, 'partido': 'PT'}, {'id': 2, 'partido': None}]", "oops", "", None]
    got = column(spark, cells, text.parse_struct_list)
    assert [(m.id, m.partido) for m in got[0]] == [(1, "PT"), (2, None)] and got[1:] == [[], [], []]
    assert column(spark, ["12", "x", None], lambda c: text.lenient(c, "int")) == [12, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["x"], lambda c: text.strict(c, "int"))


def test_keyword_rules(spark):
    values = ["Trabalho e MULHER, saúde", "Energia", None, "TURISMO", "Previdência e Assistência Social"]
    plain = column(spark, values, lambda c: lookup.keyword_category(c, fixed.KEYWORD_RULES))
    assert plain == ["Saúde", "Outro", "Indefinido", "Outro", "Outro"]
    exact = column(spark, values, lambda c: lookup.keyword_category(c, fixed.KEYWORD_RULES, fixed.CATEGORY_OF_THEME))
    assert exact == ["Saúde", "Outro", "Indefinido", "Economia", "Saúde"]


def test_lookup_defaults_and_zero_fill(spark):
    assert column(spark, ["SP", "sp", None], lambda c: lookup.mapped(c, fixed.REGION_OF_STATE, "Indefinida")) == [
        "Sudeste", "Indefinida", "Indefinida"
    ]
    states = spark.createDataFrame(list(fixed.STATE_CODES.items()), "name string, uf string")
    facts = spark.createDataFrame([("SP",), ("SP",), ("??",)], "uf string")
    got = {r.uf: r.n for r in lookup.counts_with_zeros(states, facts, "uf", "n").collect()}
    assert len(got) == 27 and got["SP"] == 2 and got["AC"] == 0


PAGES = [
    (2021, "PL", 1, 200, 2), (2021, "PL", 2, 200, 2), (2021, "PL", 3, 200, 0), (2021, "PL", 4, 200, 2),
    (2022, "PL", 1, 500, 2), (2022, "PL", 2, 200, 2), (2023, "PL", 1, 200, 1), (2023, "PL", 2, 200, 1),
]


@pytest.fixture(scope="module")
def pages(spark):
    frame = spark.createDataFrame(PAGES, "ano int, tipo string, pagina int, status int, n int")
    item = F.struct(
        (F.col("ano") * 100 + F.col("pagina")).cast("long").alias("id"), F.col("tipo").alias("siglaTipo"),
        F.col("pagina").alias("numero"), "ano", F.lit("texto").alias("ementa"),
    )
    return frame.withColumn("dados", F.array_repeat(item, F.col("n"))).drop("n")


def test_pages_stop_before_the_first_bad_one(pages):
    kept = sorted((r.ano, r.pagina) for r in landed.usable_pages(pages).collect())
    assert kept == [(2021, 1), (2021, 2), (2023, 1), (2023, 2)]
    assert sorted((r.ano, r.pagina) for r in landed.usable_pages(pages, cap=1).collect()) == [(2021, 1), (2023, 1)]
    assert landed.page_items(landed.usable_pages(pages)).columns == ["id", "tipo", "numero", "ano", "ementa"]


def test_empty_history_gives_one_null_event(spark):
    frame = spark.createDataFrame([(1, ([],)), (2, ([("2024-01-01T00:00", "s", "d", "PT", "n")],))], landed.HISTORY)
    got = {r.id: r.siglaPartido for r in landed.history_events(frame).collect()}
    assert got == {1: None, 2: "PT"}


def test_enrichment_sentinels(spark):
    bills = spark.createDataFrame([(1,), (2,)], "id long")
    authors = spark.createDataFrame(
        [(1, [(" Ana ", "u1", "Deputado"), ("Bob", "u9", "Deputado"), (" ", "u1", "")])],
        "id_bill long, dados array<struct<nome:string,uri:string,tipo:string>>",
    )
    details = spark.createDataFrame([("u1", ("PT", "SP"))], "uri string, ultimoStatus struct<siglaPartido:string,siglaUf:string>")
    labelled = enrich.author_labels(enrich.flat_authors(authors), details)
    got = {r.id: (r.autores, r.tipo_autor) for r in enrich.author_texts(bills, labelled).collect()}
    assert got == {1: ("Ana (PT-SP), Bob (?-?)", "Deputado"), 2: (enrich.NO_AUTHOR, enrich.NO_AUTHOR_TYPE)}

    movements = spark.createDataFrame(
        [(1, [(("Mesa",), "first", "2024-05-01T10:00"), ((None,), "last", "2023-01-01T10:00")])],
        "id_bill long, dados array<struct<orgao:struct<nome:string>,descricaoTramitacao:string,dataHora:string>>",
    )
    moved = {r.id: tuple(r)[1:] for r in enrich.first_and_last_movement(bills, enrich.flat_movements(movements)).collect()}
    assert moved[1] == ("Mesa", "first", "2024-05-01", "", "last", "2023-01-01")
    assert moved[2] == (enrich.NO_MOVEMENT, "", "", "", "", "")

    themes = spark.createDataFrame([(1, 0, "Saúde"), (1, 1, "Educação")], "id_bill long, seq int, tema string")
    assert {r.id: r.temas for r in enrich.theme_texts(bills, themes).collect()} == {1: "Saúde, Educação", 2: enrich.NO_THEME}


def bills(spark):
    return spark.createDataFrame(
        [
            (1, "PL", 2022, "Ana (PT-SP), Bob (PL-RJ)", "Transformado em Norma Jurídica", "saúde", "a", "2022-01-01", "2022-01-11"),
            (2, "PL", 2022, "Bob (PL-RJ)", "Arquivada", None, "b", "2022-01-01", "2022-01-01"),
            (3, "PEC", 2023, None, None, "Outra", None, "Erro", "2022-01-01"),
            (4, "PL", 2023, "Senado Federal", "Em análise", "crime", None, "2023-01-01", ""),
            (5, "PL", 2023, "Eva (REPUBLICANOS-AC)", "Em análise", "crime", "a", "2023-01-01", ""),
        ],
        "id long, tipo string, ano int, autores string, status_atual string, temas string, ementa string, "
        "data_apresentacao string, data_ultimo string",
    )


def test_all_derived_fields(spark):
    got = {r.id: r for r in enrich.enrich(bills(spark)).collect()}
    one = got[1]
    assert (one.aprovado, one.dias_tramitacao, one.tema_dominante) == (True, 10, "Saúde")
    assert (one.uf_principal, one.regiao, one.partido_principal, one.bloco_partidario) == ("SP", "Sudeste", "PT", "Esquerda")
    assert (one.autoria_coletiva, one.qtd_tramitacoes, one.apensada_ou_duplicada) == (True, 2, True)
    assert (got[2].finalizado, got[2].qtd_tramitacoes, got[2].tema_dominante, got[2].apensada_ou_duplicada) == (True, 1, "Indefinido", False)
    assert (got[3].aprovado, got[3].regiao, got[3].bloco_partidario, got[3].autoria_coletiva) == (False, "Indefinida", "Outros", False)
    assert got[3].dias_tramitacao is None and got[3].apensada_ou_duplicada and got[4].apensada_ou_duplicada
    only = enrich.enrich(bills(spark), ["regiao"])
    assert only.columns == [*bills(spark).columns, "regiao"]
    with pytest.raises(ValueError):
        enrich.enrich(bills(spark), ["nope"])


def test_search(spark):
    find = lambda **k: {r.id for r in enrich.search(bills(spark), ["PL"], [2022, 2023], **k).collect()}
    assert find() == {1, 2, 4, 5}
    assert find(states=["SP"]) == {1} and find(parties=["PL"]) == {2} and find(states=["RJ"], parties=["PT"]) == set()
    assert find(parties=["Republicanos"]) == set() and find(parties=["Republicanos"], ignore_case=True) == {5}
    with pytest.raises(ValueError):
        enrich.search(bills(spark), [], [2022])


def test_column_report_goes_on_over_a_bad_file(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "x")], "a int, b string").write.parquet(str(tmp_path / "good"))
    opened = tables.open_tables(spark, {"good": str(tmp_path / "good"), "gone": str(tmp_path / "gone")})
    got = {(r.table_name, r.column_name): (r.column_type, r.non_null) for r in tables.column_report(opened).collect()}
    assert got[("good", "a")] == ("int", 2) and got[("good", "b")] == ("string", 1)
    assert got[("gone", None)][0].startswith("error")


def test_many_rules_and_long_lists_give_the_same_rows(spark):
    rules = spark.createDataFrame([(i, f"word{i}", f"c{i}") for i in range(12)], "priority int, keyword string, category string")
    frame = spark.createDataFrame(
        [(1, "x WORD7 word3"), (2, "word11"), (3, "none"), (4, None)], "id int, t string"
    )
    whole = lookup.keyword_category_from(frame, "t", rules, "c").collect()
    parts = lookup.keyword_category_from(frame, "t", rules, "c", limit=3).collect()
    assert sorted(whole) == sorted(parts) and {r.id: r.c for r in parts} == {1: "c3", 2: "c1", 3: "Outro", 4: "Indefinido"}
    numbers = spark.range(3000).withColumn("id", F.when(F.col("id") % 5 != 0, F.col("id")))
    assert rows.members(numbers, "id", list(range(1500))).count() == 1200
    assert rows.members(numbers, "id", list(range(1500)), inside=False).count() == 1800


def test_wide_rows_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(rows, "WIDE_ROWS", 10)
    frame = spark.range(500).select(F.pmod(F.col("id") * 37, F.lit(500)).alias("k"), F.lit("text").alias("t"))
    assert rows.add_row_id(frame, ["k"]).where("ID <> k").count() == 0

"""The three chains from landed data to their last table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from billscope.plans import bills, composition, themes
from billscope.sources import landed

AS_OF = "2023-12-31"


@pytest.fixture(scope="module")
def history(spark):
    def event(moment, status, text, party, name):
        return (moment, status, text, party, name)

    rows = [
        (1, ([
            event("2021-02-01T09:00", "Exercício", "Entrada - Posse de Eleito", "PT", "Ana"),
            event("2022-03-10T10:00", "Exercício", "Alteração de partido", "REPUBLICANOS", "Ana Maria"),
            event("2023-01-31T00:00", "Fim de Mandato", "Saída", "REPUBLICANOS", "Ana Maria"),
        ],)),
        (2, ([
            event(None, "Exercício", "Posse", "PL", "?"),
            event("2021-02-01T09:00", "Exercício", "Posse de Suplente", "PL*", "Bob"),
        ],)),
        (3, ([],)),
    ]
    return spark.createDataFrame(rows, landed.HISTORY)


@pytest.mark.parametrize("chunks", [None, 16])
def test_house_composition(spark, history, chunks):
    as_of = F.lit(AS_OF).cast("date")
    tenure = composition.tenure(history, as_of, chunks)
    assert sorted(map(str, (tuple(map(str, r)) for r in tenure.collect()))) == [
        "('1', 'Ana', '2021-02-01', '2023-01-31')", "('2', 'Bob', '2021-02-01', '2023-12-31')",
    ]
    parties = composition.affiliation(history, as_of, chunks)
    assert sorted((r.id, r.sigla_partido, str(r.data_saida_partido)) for r in parties.collect()) == [
        (1, "PT", "2022-03-10"), (1, "REPUBLICANOS", "2023-12-31"), (2, "PL*", "2023-12-31"),
    ]
    days = spark.createDataFrame([("2021-06-15",), ("2022-03-10",), ("2023-05-15",), ("2020-01-15",)], "data string")
    counts = composition.composition(composition.members_by_date(tenure, parties, days))
    got = {str(r.data): (r.qtd_esquerda, r.qtd_direita, r.qtd_centrao) for r in counts.collect()}
    assert got == {"2021-06-15": (1, 0, 1), "2022-03-10": (1, 0, 1), "2023-05-15": (0, 0, 1)}
    shares = composition.bloc_shares(counts).where("bloco_partidario = 'Big Center'").collect()
    assert {str(r.data): r.percentual_deputados for r in shares}["2023-05-15"] == 100.0


@pytest.fixture(scope="module")
def raw(spark):
    pages = spark.createDataFrame(
        [(2022, "PL", 1, 200, [(1, "PL", 10, 2022, "a"), (2, "PL", 11, 2022, "b")]), (2022, "PL", 2, 200, [])], landed.PAGE
    )
    authors = spark.createDataFrame(
        [(1, [("Ana", "u1", "Deputado(a)")]), (2, [("Ana", "u1", "Deputado(a)"), ("Bob", "u2", "Deputado(a)")])],
        "id_bill long, dados array<struct<nome:string,uri:string,tipo:string>>",
    )
    details = spark.createDataFrame(
        [("u1", ("PT", "SP"))], "uri string, ultimoStatus struct<siglaPartido:string,siglaUf:string>"
    )
    movements = spark.createDataFrame(
        [(i, [(("Mesa",), "in", "2022-05-01T10:00"), (("Plenário",), "out", "2022-06-01T10:00")]) for i in (1, 2)],
        "id_bill long, dados array<struct<orgao:struct<nome:string>,descricaoTramitacao:string,dataHora:string>>",
    )
    detail = spark.createDataFrame(
        [(1, ("Transformado em Lei", "2022-06-01T10:00"), "x, y"), (2, ("Arquivada", None), None)],
        "id_bill long, statusProposicao struct<descricaoSituacao:string,dataHora:string>, ementaDetalhada string",
    )
    themes_ = spark.createDataFrame([(1, [("Saúde",), ("Turismo",)]), (2, [("Turismo",)])], "id_bill long, dados array<struct<tema:string>>")
    return bills.bill_table(pages, authors, details, movements, detail, themes_)


def test_bill_chain(spark, raw):
    features = bills.bill_features(raw)
    got = {r.id: r for r in features.collect()}
    assert got[1].autores == "Ana (PT-SP)" and got[2].autores == "Ana (PT-SP), Bob (?-?)"
    assert (got[1].data_status, got[2].data_status) == ("062022", "Data não encontrada")
    assert (got[1].dias_tramitacao, got[1].ano_eleitoral, got[1].governo) == (31, 1, "direita")
    assert (got[1].temas, got[1].tema_dominante, got[2].tema_dominante) == ("Saúde, Turismo", "Saúde", "Outro")
    trained = {r.id: r for r in bills.training_rows(features).collect()}
    assert trained[1].aprovado == 1 and trained[2].aprovado == 0 and trained[2].tema_dominante == "Economia"
    counts = spark.createDataFrame([("2022-06-15", 5)], "data string, qtd_esquerda int").withColumn("data", F.col("data").cast("date"))
    joined = {r.id: r.qtd_esquerda for r in bills.with_composition(features, counts, ["qtd_esquerda"]).collect()}
    assert joined == {1: 5, 2: None}


def test_theme_chain(spark):
    texts = ["saude publica, hospital", "escola; ensino medio", "estrada e ponte", "imposto, renda, taxa"]
    names = ["Saude, Hospital", "Educacao", "Erro: conexao", "Economia, Renda"]
    rows = [(i, f"{texts[i % 4]} {'abcdefgh'[i % 8] * (i % 5)}", names[i % 4]) for i in range(40)] + [(40, None, "Saude")]
    frame = spark.createDataFrame(rows, "id long, ementa_detalhada string, temas string")
    themed = themes.themed_rows(frame, ["id"])
    assert themed.count() == 30 and {r.tema_principal for r in themed.collect()} == {"Saude", "Educacao", "Economia"}
    out = themes.theme_clusters(themed, ks=(2, 3), starts=1)
    row = out.metrics.first()
    assert out.best_k in (2, 3) and row.best_k == out.best_k and -1 <= row.silhouette <= 1
    assert out.assignment.count() == 30
    assert out.rollup.agg(F.sum("pct_total")).first()[0] == pytest.approx(100, abs=0.1)
    encoder = lambda ts: np.array([[len(t), t.count("a"), 1.0] for t in ts])
    assert themes.with_similarity(themed, encoder).where("similaridade > 0.5").count() == 30


def test_text_cluster_variants(spark):
    frame = spark.createDataFrame([(i, ["saúde hospital médico", "imposto renda taxa", None][i % 3]) for i in range(30)], "id long, ementa string")
    got = themes.tfidf_clusters(frame, k=3, starts=2)
    assert got.count() == 30 and {"cluster", "x", "y"} <= set(got.columns)
    assert got.select("ementa", "cluster").distinct().count() == 3
    assert themes.cluster_samples(got, n=3).count() == 9
    assert themes.sentence_clusters(frame, k=3, starts=1).select("ementa", "cluster").distinct().count() == 3

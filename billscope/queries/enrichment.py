"""Bills (orders) with their authors, movements, detail record and themes (lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.operators import enrich
from billscope.queries.registry import lines_by_order, query, table

PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
PLACE_SQL = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query("j1_enrich_authors", f"""
with known as (select s_suppkey, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey where n_nationkey <> 4)
select o_orderkey,
       coalesce(string_agg('Supplier ' || l_suppkey || ' (' || coalesce(n_name, '?') || '-' || coalesce('R' || n_regionkey, '?') || ')', ', '
                           order by {PLACE_SQL}) filter (l_orderkey is not null), 'Sem autor registrado') as autores,
       coalesce(string_agg(distinct l_returnflag, ', ' order by l_returnflag), 'Não especificado') as tipo_autor
from orders left join lineitem on o_orderkey = l_orderkey left join known on l_suppkey = s_suppkey group by 1
""")
def j1_enrich_authors(spark, sf_dir):
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_nationkey <> 4")
    details = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("uri"),
        F.struct(
            F.col("n_name").alias("siglaPartido"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("siglaUf"),
        ).alias("ultimoStatus"),
    )
    authors = lines_by_order(spark, sf_dir).select(
        "l_orderkey", *PLACE, F.concat_ws(" ", F.lit("Supplier"), "l_suppkey").alias("nome"),
        F.col("l_returnflag").alias("tipo"), F.col("l_suppkey").alias("uri"),
    )
    labelled = enrich.author_labels(authors, details)
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return enrich.author_texts(orders, labelled, "o_orderkey", "l_orderkey", PLACE)


@query("j2_first_last_movement", f"""
with m as (
  select l_orderkey as k, arg_min(l_suppkey, ({PLACE_SQL})) as s1, arg_min(l_returnflag, ({PLACE_SQL})) as r1,
         arg_min(l_shipdate, ({PLACE_SQL})) as d1, arg_max(l_suppkey, ({PLACE_SQL})) as s2,
         arg_max(l_returnflag, ({PLACE_SQL})) as r2, arg_max(l_shipdate, ({PLACE_SQL})) as d2
  from lineitem group by 1
)
select o_orderkey, coalesce('S' || s1, 'Sem tramitação') as orgao_inicial, coalesce(r1, '') as descricao_inicial,
       coalesce(strftime(d1, '%Y-%m-%d'), '') as data_apresentacao, coalesce('S' || s2, '') as orgao_ultimo,
       coalesce(r2, '') as descricao_ultimo, coalesce(strftime(d2, '%Y-%m-%d'), '') as data_ultimo
from orders left join m on o_orderkey = k
""")
def j2_first_last_movement(spark, sf_dir):
    movements = lines_by_order(spark, sf_dir).select(
        "l_orderkey", *PLACE, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("orgao"),
        F.col("l_returnflag").alias("descricao"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("data_hora"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return enrich.first_and_last_movement(orders, movements, "o_orderkey", "l_orderkey", PLACE)


@query("j3_detail", """
with d as (
  select l_orderkey as k, nullif(max(l_returnflag), 'N') as status,
         case when max(l_returnflag) = 'A' then null else max(l_shipdate) end as moment, max(l_linestatus) as ementa
  from lineitem group by 1
)
select o_orderkey, coalesce(status, 'Indefinido') as status_atual,
       coalesce(strftime(moment, '%m%Y'), 'Data não encontrada') as data_status, ementa as ementa_detalhada
from orders left join d on o_orderkey = k
""")
def j3_detail(spark, sf_dir):
    latest = lines_by_order(spark, sf_dir).groupBy("l_orderkey").agg(
        F.max("l_returnflag").alias("flag"), F.max("l_shipdate").alias("shipped"), F.max("l_linestatus").alias("line")
    )
    moment = F.when(F.col("flag") != "A", F.date_format("shipped", "yyyy-MM-dd'T'HH:mm"))
    detail = latest.select(
        F.col("l_orderkey").alias("id_bill"),
        F.struct(F.nullif("flag", F.lit("N")).alias("descricaoSituacao"), moment.alias("dataHora")).alias("statusProposicao"),
        F.col("line").alias("ementaDetalhada"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return enrich.bill_detail(orders, detail, "o_orderkey")


@query("j4_theme_list", f"""
select o_orderkey, coalesce(string_agg(p_type, ', ' order by {PLACE_SQL}), 'Sem temas') as temas
from orders left join lineitem on o_orderkey = l_orderkey left join part on l_partkey = p_partkey group by 1
""")
def j4_theme_list(spark, sf_dir):
    lines, part = lines_by_order(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    themes = lines.join(part, lines.l_partkey == part.p_partkey).select(
        "l_orderkey", *PLACE, F.col("p_type").alias("tema")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return enrich.theme_texts(orders, themes, "o_orderkey", "l_orderkey", PLACE)

"""Projections, filters, look-ups, unions and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.functions import text
from billscope.operators import enrich, lookup, rows, stats
from billscope.queries.registry import query, table

PART_NULLS = "(select p_partkey, p_name, p_brand, nullif(p_type, 'PROMO') as p_type, p_size from part)"


def part_with_nulls(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", F.nullif("p_type", F.lit("PROMO")).alias("p_type"), "p_size"
    )


@query("p1_project", "select p_partkey, p_brand from part")
def p1_project(spark, sf_dir):
    return rows.keep_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_brand"])


@query("p2_row_id", f"""
select id as "ID", p_partkey, p_type from (
  select row_number() over (order by p_name, p_partkey) - 1 as id, p_partkey, p_type from {PART_NULLS}
) where p_type is not null
""")
def p2_row_id(spark, sf_dir):
    numbered = rows.add_row_id(part_with_nulls(spark, sf_dir), ["p_name", "p_partkey"])
    return rows.drop_nulls(numbered, ["p_type"]).select("ID", "p_partkey", "p_type")


@query("p3_drop_nulls", f"select * from {PART_NULLS} where p_type is not null")
def p3_drop_nulls(spark, sf_dir):
    return rows.drop_nulls(part_with_nulls(spark, sf_dir), ["p_type"])


@query("p4_reject_prefix", f"""
select p_partkey, p_type from {PART_NULLS} where not coalesce(starts_with(p_type, 'S'), false)
""")
def p4_reject_prefix(spark, sf_dir):
    return rows.reject_prefix(part_with_nulls(spark, sf_dir), "p_type", "S").select("p_partkey", "p_type")


@query("p5_null_safe_ne", f"select p_partkey, p_type from {PART_NULLS} where p_type is distinct from 'LARGE'")
def p5_null_safe_ne(spark, sf_dir):
    return rows.not_equal(part_with_nulls(spark, sf_dir), "p_type", "LARGE").select("p_partkey", "p_type")


@query("p6_conjunction", """
select 'approved' as outcome, o_orderkey from orders where o_orderstatus = 'F'
union all
select 'rejected', o_orderkey from orders
where o_orderstatus <> 'F' and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')
""")
def p6_conjunction(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    approved = F.col("o_orderstatus") == "F"
    finished = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    return rows.union_all([
        rows.approved_rows(orders, approved).select(F.lit("approved").alias("outcome"), "o_orderkey"),
        rows.rejected_rows(orders, approved, finished).select(F.lit("rejected").alias("outcome"), "o_orderkey"),
    ])


@query("p7_membership", f"""
select p_partkey, p_type, coalesce(p_type in ('SMALL', 'MEDIUM'), false) as inside from {PART_NULLS}
""")
def p7_membership(spark, sf_dir):
    part = part_with_nulls(spark, sf_dir).select("p_partkey", "p_type")
    wanted = table(spark, sf_dir, "part").select("p_type").where(F.col("p_type").isin("SMALL", "MEDIUM")).distinct()
    inside, outside = rows.split_by_membership(part, "p_type", wanted)
    return rows.union_all([
        inside.withColumn("inside", F.lit(True)), outside.withColumn("inside", F.lit(False))
    ])


@query("p8_conditional_update", """
select o_orderkey, case when o_orderstatus = 'F' then 'DONE' else o_orderpriority end as o_orderpriority from orders
""")
def p8_conditional_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rows.update_where(orders, F.col("o_orderstatus") == "F", "o_orderpriority", "DONE").drop("o_orderstatus")


@query("p9_lenient_cast", """
select o_orderkey,
       coalesce(try_cast(case when o_orderstatus = 'P' then 'x' else '' end || o_orderkey as double), -1) as number,
       strftime(try_cast(case when o_orderstatus = 'O' then 'bad' else strftime(o_orderdate, '%Y-%m-%d') end as date), '%Y-%m-%d') as day
from orders
""")
def p9_lenient_cast(spark, sf_dir):
    status = F.col("o_orderstatus")
    number = F.concat(F.when(status == "P", "x").otherwise(""), F.col("o_orderkey").cast("string"))
    day = F.when(status == "O", "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.coalesce(text.lenient(number, "double"), F.lit(-1.0)).alias("number"),
        F.date_format(text.lenient(day, "date"), "yyyy-MM-dd").alias("day"),
    )


@query("p10_strict_cast", """
select o_orderkey, cast(strftime(o_orderdate, '%Y') as int) as ano, cast(o_totalprice as bigint) as whole_price
from (select o_orderkey, o_orderdate, floor(o_totalprice) as o_totalprice from orders)
""")
def p10_strict_cast(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.strict(F.date_format("o_orderdate", "yyyy"), "int").alias("ano"),
        text.strict(F.floor("o_totalprice").cast("double"), "bigint").alias("whole_price"),
    )


@query("p11_fill_null", f"select p_partkey, coalesce(p_type, '') as p_type from {PART_NULLS}")
def p11_fill_null(spark, sf_dir):
    return rows.fill_nulls(part_with_nulls(spark, sf_dir).select("p_partkey", "p_type"), {"p_type": ""})


@query("p12_numeric_columns", """
select o_orderkey, 'o_custkey' as name, o_custkey::double as value from orders
union all select o_orderkey, 'o_totalprice', o_totalprice from orders
""")
def p12_numeric_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    numbers = [c for c in rows.numeric_columns(orders) if c != "o_orderkey"]
    doubles = orders.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in numbers])
    return rows.long_form(doubles, ["o_orderkey"], numbers, "name", "value")


def placed_orders(spark, sf_dir):
    """Orders with the customer's nation (state), segment (party) and the order year."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .withColumn("ano", F.year("o_orderdate"))
    )


@query("p13_faceted_search", """
select o_orderkey, o_orderstatus as tipo, year(o_orderdate)::int as ano, n_name as uf, c_mktsegment as partido
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus in ('F', 'O') and year(o_orderdate) in (1996, 1998, 2000)
  and n_name in ('NATION_1', 'NATION_7', 'NATION_13') and c_mktsegment in ('BUILDING', 'MACHINERY')
""")
def p13_faceted_search(spark, sf_dir):
    labelled = placed_orders(spark, sf_dir)
    found = enrich.search(
        labelled, ["F", "O"], [1996, 1998, 2000],
        states=["NATION_1", "NATION_7", "NATION_13"], parties=["BUILDING", "MACHINERY"],
        type_column="o_orderstatus", state=F.col("n_name"), party=F.col("c_mktsegment"),
    )
    return found.select(
        "o_orderkey", F.col("o_orderstatus").alias("tipo"), "ano",
        F.col("n_name").alias("uf"), F.col("c_mktsegment").alias("partido"),
    )


@query("p14_optional_enrich", """
select o_orderkey as id, o_orderstatus = 'F' as aprovado,
       case n_regionkey when 0 then 'Norte' when 1 then 'Sul' else 'Indefinida' end as regiao,
       contains(o_orderpriority, ',') as autoria_coletiva,
       count(*) over (partition by o_totalprice) > 1 as apensada_ou_duplicada
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""")
def p14_optional_enrich(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Transformado em Lei").otherwise("Aguardando parecer")
    author = F.concat_ws("", F.lit("A ("), F.col("o_orderpriority"), F.lit("-R"), F.col("n_regionkey"), F.lit(")"))
    bills = placed_orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), status.alias("status_atual"), author.alias("autores"),
        F.col("o_totalprice").cast("string").alias("ementa"),
    )
    out = enrich.enrich(
        bills, ["aprovado", "regiao", "autoria_coletiva", "apensada_ou_duplicada"],
        regions={"R0": "Norte", "R1": "Sul"},
    )
    return out.select("id", "aprovado", "regiao", "autoria_coletiva", "apensada_ou_duplicada")


@query("j5_lookup_default", """
select c_custkey, case when n_nationkey < 20 then r_name else 'Indefinida' end as regiao,
       coalesce(case c_mktsegment when 'BUILDING' then 'Esquerda' when 'MACHINERY' then 'Direita' end, 'Outros') as bloco
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def j5_lookup_default(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dimension = nation.join(region, nation.n_regionkey == region.r_regionkey).where("n_nationkey < 20").select(
        "n_nationkey", F.col("r_name").alias("regiao")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    found = lookup.lookup(customer, dimension, {"c_nationkey": "n_nationkey"}, {"regiao": "Indefinida"})
    bloc = lookup.mapped(F.col("c_mktsegment"), {"BUILDING": "Esquerda", "MACHINERY": "Direita"}, "Outros")
    return found.select("c_custkey", "regiao", bloc.alias("bloco"))


@query("j6_month_key_join", """
with monthly as (
  select date_trunc('month', o_orderdate)::date as m, count(*) as qtd from orders
  where month(o_orderdate) not in (2, 11) group by 1
)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%m%Y') as data_status,
       coalesce(qtd, -1) as qtd
from lineitem left join monthly on date_trunc('month', l_shipdate)::date = m
""")
def j6_month_key_join(spark, sf_dir):
    monthly = (
        table(spark, sf_dir, "orders")
        .where(~F.month("o_orderdate").isin(2, 11))
        .groupBy(lookup.month_of(F.col("o_orderdate")).alias("data"))
        .agg(F.count(F.lit(1)).alias("qtd"))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    joined = lookup.join_by_month(lines, "l_shipdate", monthly, "data")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "MMyyyy").alias("data_status"), F.coalesce("qtd", F.lit(-1)).alias("qtd"),
    )


@query("j7_zero_fill", """
select n_nationkey, n_name, count(c_custkey) as rich from nation
left join (select * from customer where c_acctbal > 9990) on c_nationkey = n_nationkey group by 1, 2
""")
def j7_zero_fill(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(
        F.col("c_nationkey").alias("n_nationkey")
    )
    dimension = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return lookup.counts_with_zeros(dimension, rich, "n_nationkey", "rich")


RULES = [("red", "Cor"), ("blue", "Cor"), ("ring", "Forma"), ("widget", "Forma"), ("hot", "Calor"), ("o", "Resto")]
EXACT = {"SMALL GEAR": "Exato", "new plate": "Exato", "large anvil": "Exato"}
RULE_SQL = """case when p_name is null then 'Indefinido'
     when contains(lower(p_name), 'red') then 'Cor' when contains(lower(p_name), 'blue') then 'Cor'
     when contains(lower(p_name), 'ring') then 'Forma' when contains(lower(p_name), 'widget') then 'Forma'
     when contains(lower(p_name), 'hot') then 'Calor' when contains(lower(p_name), 'o') then 'Resto'
"""
NAME_NULLS = "(select p_partkey, upper(nullif(p_name, 'hot rod')) as p_name from part)"


def named_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.nullif("p_name", F.lit("hot rod"))).alias("p_name")
    )


@query("j10_keyword_rules", f"""
select p_partkey, {RULE_SQL} else 'Outro' end as categoria, {RULE_SQL} else 'Outro' end as categoria_tabela
from {NAME_NULLS}
""")
def j10_keyword_rules(spark, sf_dir):
    parts = named_parts(spark, sf_dir)
    rules = spark.createDataFrame(
        [(i, k, c) for i, (k, c) in enumerate(RULES)], "priority int, keyword string, category string"
    )
    tabled = lookup.keyword_category_from(parts, "p_name", rules, "categoria_tabela")
    return tabled.select(
        "p_partkey", lookup.keyword_category(F.col("p_name"), RULES).alias("categoria"), "categoria_tabela"
    )


@query("j11_keyword_rules_exact", f"""
select p_partkey, {RULE_SQL}
  when lower(p_name) in ('small gear', 'new plate', 'large anvil') then 'Exato' else 'Outro' end as categoria
from {NAME_NULLS}
""")
def j11_keyword_rules_exact(spark, sf_dir):
    return named_parts(spark, sf_dir).select(
        "p_partkey", lookup.keyword_category(F.col("p_name"), RULES, EXACT).alias("categoria")
    )


@query("u1_union_all", """
select o_orderkey, year(o_orderdate)::int as ano, o_orderstatus as tipo from orders
where year(o_orderdate) in (1996, 1999) and o_orderstatus in ('F', 'P')
""")
def u1_union_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("ano"), F.col("o_orderstatus").alias("tipo")
    )
    return rows.union_all([
        orders.where((F.col("ano") == year) & (F.col("tipo") == kind)) for year in (1996, 1999) for kind in ("F", "P")
    ])


U5_MONTHS = ["1996-01", "1996-02", "1997-12", "2000-06"]


@query("u5_complement_split", """
select strftime(o_orderdate, '%Y-%m') in ('1996-01', '1996-02', '1997-12', '2000-06') as before_side,
       count(*) as n_rows, sum(o_orderkey)::bigint as key_sum from orders group by 1
""")
def u5_complement_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    inside, outside = rows.split_by_membership(orders, "m", U5_MONTHS)
    both = rows.union_all([
        inside.withColumn("before_side", F.lit(True)), outside.withColumn("before_side", F.lit(False))
    ])
    return both.groupBy("before_side").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum")
    )


MONTH_STATUS = """(
  select date_trunc('month', o_orderdate)::date as m,
         count(*) filter (o_orderstatus = 'F') as left_n, count(*) filter (o_orderstatus = 'O') as center_n,
         count(*) filter (o_orderstatus = 'P') as right_n
  from orders group by 1
)"""


def month_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(lookup.month_of(F.col("o_orderdate")).alias("m")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("left_n"),
        F.count_if(F.col("o_orderstatus") == "O").alias("center_n"),
        F.count_if(F.col("o_orderstatus") == "P").alias("right_n"),
    )


@query("a16_row_percent", f"""
select strftime(m, '%Y-%m-%d') as m, left_n + center_n + right_n as total,
       round(left_n * 100.0 / nullif(left_n + center_n + right_n, 0), 6) as left_n,
       round(center_n * 100.0 / nullif(left_n + center_n + right_n, 0), 6) as center_n,
       round(right_n * 100.0 / nullif(left_n + center_n + right_n, 0), 6) as right_n
from {MONTH_STATUS}
""")
def a16_row_percent(spark, sf_dir):
    shares = stats.row_shares(month_status(spark, sf_dir), ["left_n", "center_n", "right_n"])
    return shares.select(
        F.date_format("m", "yyyy-MM-dd").alias("m"), "total",
        *[F.round(c, 6).alias(c) for c in ("left_n", "center_n", "right_n")],
    )


@query("u4_unpivot", f"""
select strftime(m, '%Y-%m-%d') as m, 'Left' as bloc, left_n as n from {MONTH_STATUS}
union all select strftime(m, '%Y-%m-%d'), 'Big Center', center_n from {MONTH_STATUS}
union all select strftime(m, '%Y-%m-%d'), 'Right', right_n from {MONTH_STATUS}
""")
def u4_unpivot(spark, sf_dir):
    wide = month_status(spark, sf_dir).withColumn("m", F.date_format("m", "yyyy-MM-dd"))
    tall = rows.long_form(wide, ["m"], ["left_n", "center_n", "right_n"], "bloc", "n")
    names = {"left_n": "Left", "center_n": "Big Center", "right_n": "Right"}
    return tall.withColumn("bloc", lookup.mapped(F.col("bloc"), names))


@query("w1_duplicate_flag", "select doc_id, count(*) over (partition by text) > 1 as duplicated from documents")
def w1_duplicate_flag(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return enrich.duplicate_flag(documents, "text", "duplicated").select("doc_id", "duplicated")

"""Scans, sinks and landed pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from billscope.operators.ordered import row_numbers, running_sums, with_chunks
from billscope.queries.registry import query, table
from billscope.shared import fresh_path
from billscope.sources import landed, tables

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def landed_pages(spark, sf_dir):
    """Lineitem packed into listing pages of 100 per (year, flag) run, one page emptied per run."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"ano": F.year("l_shipdate"), "tipo": F.col("l_returnflag")}
    )
    run = ["ano", "tipo"]
    numbered = running_sums(
        with_chunks(lines, LINE_ORDER, keys=run), run, LINE_ORDER, {"n": F.lit(1).cast("long")}, totals=True
    )
    item = F.struct(
        F.col("l_orderkey").alias("id"),
        F.col("l_linestatus").alias("siglaTipo"),
        F.col("l_linenumber").alias("numero"),
        F.col("ano").alias("ano"),
        F.concat_ws(" ", F.lit("part"), F.col("l_partkey"), F.lit("supplier"), F.col("l_suppkey")).alias("ementa"),
    )
    pages = (
        numbered.withColumn("pagina", F.ceil(F.col("n") / 100).cast("int"))
        .withColumn("broken", F.ceil(F.ceil(F.col("n_total") / 100) * 0.8).cast("int"))
        .groupBy(*run, "pagina")
        .agg(F.max("broken").alias("broken"), F.collect_list(item).alias("dados"))
    )
    empty = F.array().cast(landed.PAGE["dados"].dataType)
    pages = pages.withColumn("dados", F.when(F.col("pagina") == F.col("broken"), empty).otherwise(F.col("dados")))
    path = fresh_path(spark, "pages")
    pages.select("ano", "tipo", "pagina", F.lit(200).alias("status"), "dados").write.json(path)
    return path


PAGE_CTE = """
with lines as (
  select *, year(l_shipdate)::int as ano, l_returnflag as tipo from lineitem
), numbered as (
  select *, row_number() over (partition by ano, tipo order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as n,
         count(*) over (partition by ano, tipo) as total
  from lines
), placed as (
  select *, ceil(n / 100.0)::int as pagina, ceil(ceil(total / 100.0) * 0.8)::int as broken from numbered
)
"""


@query("s1_paged_scan", PAGE_CTE + """
select ano, tipo, pagina, count(*) as n_items, sum(l_orderkey)::bigint as id_sum
from placed where pagina < broken group by ano, tipo, pagina
""")
def s1_paged_scan(spark, sf_dir):
    pages = landed.read_json(spark, landed_pages(spark, sf_dir), landed.PAGE)
    ids = F.aggregate("dados.id", F.lit(0).cast("long"), lambda s, i: s + i)
    return landed.usable_pages(pages).select(
        "ano", "tipo", "pagina", F.size("dados").cast("long").alias("n_items"), ids.alias("id_sum")
    )


@query("s1_capped_scan", PAGE_CTE + """
select ano, tipo, pagina, count(*) as n_items
from placed where pagina < broken and (tipo <> 'A' or pagina < 2) and pagina <= 3 group by ano, tipo, pagina
""")
def s1_capped_scan(spark, sf_dir):
    """Pages up to the third; runs of one kind fail with a server error on their second page."""
    pages = landed.read_json(spark, landed_pages(spark, sf_dir), landed.PAGE)
    failing = (F.col("tipo") == "A") & (F.col("pagina") == 2)
    pages = pages.withColumn("status", F.when(failing, 503).otherwise(F.col("status")))
    return landed.usable_pages(pages, cap=3).select("ano", "tipo", "pagina", F.size("dados").cast("long").alias("n_items"))


@query("s2_project_items", PAGE_CTE + """
select l_orderkey as id, l_linestatus as tipo, l_linenumber as numero, ano,
       concat_ws(' ', 'part', l_partkey, 'supplier', l_suppkey) as ementa
from placed where pagina < broken
""")
def s2_project_items(spark, sf_dir):
    pages = landed.read_json(spark, landed_pages(spark, sf_dir), landed.PAGE)
    return landed.page_items(landed.usable_pages(pages))


@query("s3_source_filter", """
select o_orderkey, o_totalprice, year(o_orderdate)::int as ano, o_orderstatus as tipo
from orders where year(o_orderdate) in (1996, 1997) and o_orderstatus = 'F'
order by o_orderkey desc limit 500
""")
def s3_source_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("ano"), F.col("o_orderstatus").alias("tipo")
    )
    path = fresh_path(spark, "orders-by-year")
    tables.write_parquet(orders.repartition("ano", "tipo", F.pmod("o_orderkey", F.lit(8))), path, ["ano", "tipo"])
    wanted = F.col("ano").isin(1996, 1997) & (F.col("tipo") == "F")
    return landed.source_filter(spark.read.parquet(path), wanted, "o_orderkey", pages=5)


NATION = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()),
    T.StructField("n_name", T.StringType()),
    T.StructField("n_regionkey", T.IntegerType()),
])
PART = T.StructType([
    T.StructField("p_partkey", T.LongType()),
    T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()),
    T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()),
    T.StructField("p_retailprice", T.DoubleType()),
])


@query("s4_table_scan", "select p_partkey, p_name, p_size from part")
def s4_table_scan(spark, sf_dir):
    return tables.scan(spark, f"{sf_dir}/part.parquet", PART).select("p_partkey", "p_name", "p_size")


@query("s5_nested_history_scan", """
select user_id as id, ((row_number() over (partition by user_id order by ts, event_id) - 1) % 100)::int as pos,
       strftime(ts, '%Y-%m-%dT%H:%M') as data_hora, event_type as situacao
from events
""")
def s5_nested_history_scan(spark, sf_dir):
    """Events packed per user into history records of at most 100 events, landed and read back."""
    numbered = row_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "n")
    event = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("dataHora"), F.col("event_type").alias("situacao")
    )
    packed = numbered.groupBy(F.col("user_id").alias("id"), F.floor((F.col("n") - 1) / 100).alias("record")).agg(
        F.sort_array(F.collect_list(F.struct("n", event.alias("e")))).alias("rows")
    )
    path = fresh_path(spark, "history")
    packed.select("id", F.struct(F.col("rows.e").alias("dados")).alias("historico")).write.json(path)
    events = landed.history_events(landed.read_json(spark, path, landed.HISTORY))
    return events.select("id", "pos", F.col("dataHora").alias("data_hora"), "situacao")


@query("s6_parquet_sink", "select * from part")
def s6_parquet_sink(spark, sf_dir):
    path = fresh_path(spark, "part")
    tables.write_parquet(table(spark, sf_dir, "part"), path)
    return tables.scan(spark, path, PART)


@query("s7_csv_sink", """
select p_partkey, '["' || replace(p_name, ' ', '","') || '"]' as words, p_retailprice from part
""")
def s7_csv_sink(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), "p_retailprice")
    path = fresh_path(spark, "part-csv")
    tables.write_csv(part, path)
    schema = T.StructType([
        T.StructField("p_partkey", T.LongType()),
        T.StructField("words", T.StringType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ])
    return tables.scan(spark, path, schema, "csv", header="true", escape='"')


ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Spark's names of the column types that the tables hold.
TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
    "FLOAT[]": "array<float>", "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP WITH TIME ZONE": "timestamp",
}
REPORT_SQL = "\nunion all\n".join(f"""
select '{t}' as table_name, (place - 1)::int as position, d.column_name, t.spark as column_type, coalesce(c.n, 0)::bigint as non_null
from (select column_name, column_type, row_number() over () as place from (describe {t})) d
join (values {", ".join(f"('{k}', '{v}')" for k, v in TYPE_NAMES.items())}) t(duck, spark) on t.duck = d.column_type
left join (unpivot (select count(columns(*)) from {t}) on columns(*) into name column_name value n) c on c.column_name = d.column_name
""" for t in ALL_TABLES)


@query("s8_schema_report", REPORT_SQL)
def s8_schema_report(spark, sf_dir):
    return tables.column_report(
        tables.open_tables(spark, {t: f"{sf_dir}/{t}.parquet" for t in ALL_TABLES})
    )

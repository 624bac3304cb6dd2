"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.functions import dates, text
from billscope.queries.registry import lines_by_order, query, table, texts

STRIP_SQL = r"regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')"
PARTS_SQL = f"list_filter(list_transform(string_split_regex(text, '[,;]'), lambda x: {STRIP_SQL}), lambda x: x <> '')"


@query("f1_split_trim", f"""
select doc_id, len(parts)::int as n_parts, array_to_string(parts, '|') as parts from (select doc_id, {PARTS_SQL} as parts from documents)
""")
def f1_split_trim(spark, sf_dir):
    parts = text.split_trim(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", parts.alias("parts")).select(
        "doc_id", F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("parts")
    )


@query("f2_first_or_default", f"""
select doc_id, coalesce(parts[1], 'Desconhecido') as first_part
from (select doc_id, {PARTS_SQL.replace("text,", "case when doc_id % 5 = 0 then ' ; ' else text end,")} as parts from documents)
""")
def f2_first_or_default(spark, sf_dir):
    source = F.when(F.col("doc_id") % 5 == 0, F.lit(" ; ")).otherwise(F.col("text"))
    return texts(spark, sf_dir).select(
        "doc_id", text.first_or(text.split_trim(source)).alias("first_part")
    )


def supplier_labels(spark, sf_dir):
    """Per order ``supplier (BRAND-NATION)`` labels of its lines in line order."""
    lines = lines_by_order(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    label = text.author_label(
        F.col("s_name"), F.nullif("p_brand", F.lit("Brand#3")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    )
    return (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .join(part, lines.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", label.alias("label"))
        )).alias("rows"))
        .select("l_orderkey", F.array_join("rows.label", ", ").alias("labels"))
    )


LABELS_SQL = """(
  select l_orderkey,
         string_agg(s_name || ' (' || coalesce(nullif(p_brand, 'Brand#3'), '?') || '-N' || s_nationkey || ')', ', '
                    order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as labels,
         arg_min('N' || s_nationkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) as uf,
         arg_min(coalesce(nullif(p_brand, 'Brand#3'), '?'), (l_linenumber, l_partkey, l_suppkey, l_shipdate)) as partido,
         string_agg('N' || s_nationkey, ', ' order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as ufs,
         string_agg(coalesce(nullif(p_brand, 'Brand#3'), '?'), ', ' order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as partidos,
         count(*) as n
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1
)"""


@query("f3_first_uf", f"select l_orderkey, uf from {LABELS_SQL}")
def f3_first_uf(spark, sf_dir):
    return supplier_labels(spark, sf_dir).select("l_orderkey", text.first_state(F.col("labels")).alias("uf"))


@query("f4_first_party", f"select l_orderkey, partido from {LABELS_SQL}")
def f4_first_party(spark, sf_dir):
    return supplier_labels(spark, sf_dir).select("l_orderkey", text.first_party(F.col("labels")).alias("partido"))


@query("f5_all_uf_party", f"select l_orderkey, ufs, partidos from {LABELS_SQL}")
def f5_all_uf_party(spark, sf_dir):
    labels = F.col("labels")
    return supplier_labels(spark, sf_dir).select(
        "l_orderkey",
        text.joined_or_null(text.all_states(labels)).alias("ufs"),
        text.joined_or_null(text.all_parties(labels)).alias("partidos"),
    )


@query("f7_collective_flag", f"select l_orderkey, n > 1 as coletiva from {LABELS_SQL}")
def f7_collective_flag(spark, sf_dir):
    return supplier_labels(spark, sf_dir).select("l_orderkey", text.has_comma(F.col("labels")).alias("coletiva"))


@query("f14_compose_label", """
select s_suppkey, case when s_suppkey % 9 = 0 then null
  else s_name || ' (' || coalesce(nullif(n_name, 'NATION_3'), '?') || '-N' || n_nationkey || ')' end as label
from supplier join nation on s_nationkey = n_nationkey
""")
def f14_compose_label(spark, sf_dir):
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.when(F.col("s_suppkey") % 9 == 0, F.lit(" \t")).otherwise(F.concat(F.col("s_name"), F.lit(" ")))
    party, state = F.nullif("n_name", F.lit("NATION_3")), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", text.author_label(name, party, state).alias("label")
    )


TERMS = ["ÉLE", "tion DE", "The of", "(x)"]


@query("f6_any_term_flag", """
select doc_id, contains(lower(text), 'éle') or contains(lower(text), 'tion de') or contains(lower(text), 'the of')
  or contains(lower(text), '(x)') as hit from documents
""")
def f6_any_term_flag(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", text.any_term(F.col("text"), TERMS).alias("hit"))


@query("f22_lower_match", """
select p_partkey, lower(p_type) = lower(case when p_size % 2 = 0 then 'Promo' else 'sMALL' end) as same from part
""")
def f22_lower_match(spark, sf_dir):
    wanted = F.when(F.col("p_size") % 2 == 0, F.lit("Promo")).otherwise(F.lit("sMALL"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.same_ignoring_case(F.col("p_type"), wanted).alias("same")
    )


def order_spans(spark, sf_dir):
    """Per order its date and last ship date as texts, with bad texts and equal dates mixed in."""
    lines = lines_by_order(spark, sf_dir).groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"), F.max("l_linenumber").alias("n")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    first = F.date_format("o_orderdate", "yyyy-MM-dd")
    last = F.when(F.col("n") == 1, F.lit("Erro")).when(F.col("n") == 2, first).otherwise(
        F.date_format("last_ship", "yyyy-MM-dd")
    )
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", first.alias("d1"), last.alias("d2")
    )


SPANS_SQL = """(
  select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d1,
         case when n = 1 then 'Erro' when n = 2 then strftime(o_orderdate, '%Y-%m-%d') else strftime(s, '%Y-%m-%d') end as d2
  from orders join (select l_orderkey, max(l_shipdate) as s, max(l_linenumber) as n from lineitem group by 1) on o_orderkey = l_orderkey
)"""


@query("f8_days_between", f"""
select o_orderkey, coalesce(date_diff('day', try_cast(d1 as date), try_cast(d2 as date)), -9999)::int as days from {SPANS_SQL}
""")
def f8_days_between(spark, sf_dir):
    days = dates.days_between(F.col("d1"), F.col("d2"))
    return order_spans(spark, sf_dir).select("o_orderkey", F.coalesce(days, F.lit(-9999)).alias("days"))


@query("f9_equal_flag", f"""
select o_orderkey, case when try_cast(d1 as date) = try_cast(d2 as date) then 1 else 2 end as steps from {SPANS_SQL}
""")
def f9_equal_flag(spark, sf_dir):
    return order_spans(spark, sf_dir).select("o_orderkey", dates.step_count(F.col("d1"), F.col("d2")).alias("steps"))


ORDER_DAY = "nullif(o_orderdate::date, date '1998-08-02')"


def order_days(spark, sf_dir):
    day = F.nullif(F.col("o_orderdate").cast("date"), F.lit("1998-08-02").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))


@query("f10_year_flag", f"""
select o_orderkey, case when year({ORDER_DAY}) in (1998) then 1 else 0 end as ano_eleitoral from orders
""")
def f10_year_flag(spark, sf_dir):
    return order_days(spark, sf_dir).select("o_orderkey", dates.year_flag(F.col("day"), [1998]).alias("ano_eleitoral"))


@query("f11_period_label", f"""
select o_orderkey, case when year({ORDER_DAY}) in (1997, 1998) then 'direita' else 'esquerda' end as governo from orders
""")
def f11_period_label(spark, sf_dir):
    label = dates.period_label(F.col("day"), [1997, 1998], "direita", "esquerda")
    return order_days(spark, sf_dir).select("o_orderkey", label.alias("governo"))


@query("f12_month_key", f"""
select o_orderkey, coalesce(strftime({ORDER_DAY}, '%m%Y'), 'Data não encontrada') as data_status from orders
""")
def f12_month_key(spark, sf_dir):
    moment = F.date_format("day", "yyyy-MM-dd'T'HH:mm")
    return order_days(spark, sf_dir).select("o_orderkey", dates.month_key(moment).alias("data_status"))


@query("f13_parse_iso", """
select event_id, strftime(ts, '%Y-%m-%d') as day,
       case when event_type = 'view' then null else strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') end as minute
from events
""")
def f13_parse_iso(spark, sf_dir):
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    written = F.when(F.col("event_type") == "view", F.concat(written, F.lit(" (visto)"))).otherwise(written)
    return table(spark, sf_dir, "events").select("event_id", written.alias("w")).select(
        "event_id",
        dates.day_text(F.col("w")).alias("day"),
        F.date_format(dates.iso_minute(F.col("w")), "yyyy-MM-dd HH:mm:ss").alias("minute"),
    )


@query("f18_month_series", """
with b as (select min(o_orderdate)::date as lo, max(o_orderdate)::date as hi from orders),
m as (select unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date + 14 as d from b)
select strftime(d, '%Y-%m-%d') as reference_day, count(o_orderkey) as placed_by_then
from m left join orders on o_orderdate::date <= d and date_trunc('month', o_orderdate) = date_trunc('month', d)
where d <= date '2001-06-20' group by 1
""")
def f18_month_series(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("placed"))
    span = orders.agg(F.min("placed").alias("lo"), F.max("placed").alias("hi"))
    days = span.select(
        F.explode(dates.month_days(F.col("lo"), F.col("hi"), 15, F.lit("2001-06-20").cast("date"))).alias("d")
    )
    early = orders.where(F.dayofmonth("placed") <= 15).groupBy(F.trunc("placed", "MM").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return days.join(early, F.trunc("d", "MM") == F.col("m"), "left").select(
        F.date_format("d", "yyyy-MM-dd").alias("reference_day"), F.coalesce("n", F.lit(0)).alias("placed_by_then")
    )


@query("f15_nested_get", """
select event_id, coalesce(json_extract_string(case when event_id % 6 = 0 then '{}' else props end, '$.k'), '?') as k from events
""")
def f15_nested_get(spark, sf_dir):
    props = F.when(F.col("event_id") % 6 == 0, F.lit("{}")).otherwise(F.col("props"))
    parsed = F.from_json(props, "k string")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select(
        "event_id", text.nested_or(F.col("p.k"), "?").alias("k")
    )


@query("f17_clean_symbol", r"""
select l_orderkey, l_partkey, l_suppkey, l_linenumber, trim(replace(' *' || l_returnflag || ' *', '*', '')) as flag from lineitem
""")
def f17_clean_symbol(spark, sf_dir):
    marked = F.concat(F.lit(" *"), F.col("l_returnflag"), F.lit(" *"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.clean_symbol(marked).alias("flag")
    )


@query("f21_round2", """
select o_orderkey, round_even(o_totalprice / 7 * 100, 0) / 100 as rounded from orders
""")
def f21_round2(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.round2(F.col("o_totalprice") / 7).alias("rounded"))


@query("f23_to_text", "select p_partkey, p_size::varchar as size_text, (p_size > 25)::varchar as big_text from part")
def f23_to_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.to_text(F.col("p_size")).alias("size_text"),
        text.to_text(F.col("p_size") > 25).alias("big_text"),
    )

"""Counts, rates, statistics and per-group leaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.functions import text
from billscope.operators import shares, stats
from billscope.operators.intervals import bloc_counts, collect_members, sum_parts
from billscope.operators.lookup import mapped
from billscope.queries.registry import lines_by_order, query, table, texts
from billscope.queries.rowwise import placed_orders


@query("a1_value_counts", """
select case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when 'es' then 'Spanish' end as lang,
       count(*) as "count" from documents where lang is not null group by 1
""")
def a1_value_counts(spark, sf_dir):
    names = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    return stats.value_counts(table(spark, sf_dir, "documents"), "lang", labels=names)


@query("a2_share_of_total", """
select lang, count(*) as "count", round(count(*) * 100.0 / sum(count(*)) over (), 6) as share from documents group by lang
""")
def a2_share_of_total(spark, sf_dir):
    out = stats.share_of_total(table(spark, sf_dir, "documents"), "lang")
    return out.withColumn("share", F.round("share", 6))


@query("a3_multivalue_counts", r"""
select item, count(*) as "count" from (
  select unnest(list_transform(string_split_regex(text, '[,;]'),
         lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'))) as item from documents
) where item <> '' group by item
""")
def a3_multivalue_counts(spark, sf_dir):
    return stats.list_counts(texts(spark, sf_dir), text.split_trim(F.col("text")), "item")


@query("u3_flatten", """
select p_brand, w as word, count(*) as n from (select p_brand, unnest(string_split(p_name, ' ')) as w from part)
group by 1, 2
""")
def u3_flatten(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("p_brand", "word").agg(F.count(F.lit(1)).alias("n"))


def nation_counts(spark, sf_dir):
    orders = placed_orders(spark, sf_dir)
    return stats.count_and_sum(
        orders, ["n_name", "n_regionkey"], F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    )


NATION_COUNTS = """(
  select n_name, n_regionkey, count(o_orderkey) as submitted, count(*) filter (o_orderstatus = 'F') as approved
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2
)"""


@query("a4_group_count_sum", f"select n_name, submitted, approved from {NATION_COUNTS}")
def a4_group_count_sum(spark, sf_dir):
    return nation_counts(spark, sf_dir).drop("n_regionkey")


@query("a5_rate_by_group", f"""
select n_name, submitted, approved, case n_regionkey when 0 then 'Esquerda' when 1 then 'Direita' when 2 then 'Centro' end as bloc,
       round(approved * 100.0 / nullif(submitted, 0), 6) as rate
from {NATION_COUNTS} where n_regionkey < 3
""")
def a5_rate_by_group(spark, sf_dir):
    blocs = {"0": "Esquerda", "1": "Direita", "2": "Centro"}
    counts = nation_counts(spark, sf_dir)
    rated = stats.rate_by_group(counts, mapped(F.col("n_regionkey").cast("string"), blocs))
    return rated.select("n_name", "submitted", "approved", "bloc", F.round("rate", 6).alias("rate"))


@query("a6_rate_two_level", f"""
select r_name as bloc, sum(submitted)::bigint as submitted, sum(approved)::bigint as approved,
       round(sum(approved) * 100.0 / nullif(sum(submitted), 0), 6) as rate
from {NATION_COUNTS} join region on n_regionkey = r_regionkey group by 1
""")
def a6_rate_two_level(spark, sf_dir):
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("bloc"))
    counts = nation_counts(spark, sf_dir)
    named = counts.join(region, counts.n_regionkey == region.r_regionkey, "left")
    return stats.rate_two_level(named, "bloc").withColumn("rate", F.round("rate", 6))


@query("a7_fixed_category_counts", """
select k as category, count(o_orderkey) as "count"
from (values ('1-URGENT'), ('3-MEDIUM'), ('9-NEVER')) v(k) left join orders on o_orderpriority = k group by k
""")
def a7_fixed_category_counts(spark, sf_dir):
    return stats.fixed_category_counts(
        table(spark, sf_dir, "orders"), F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM", "9-NEVER"], "category"
    )


FLAG_BLOCS = {"A": "Esquerda", "N": "Direita", "R": "Centrão"}
BLOC_COLUMNS = {"Esquerda": "qtd_esquerda", "Direita": "qtd_direita", "Centrão": "qtd_centrao"}


def order_members(spark, sf_dir):
    """One array of (line key, starred flag) per order."""
    lines = lines_by_order(spark, sf_dir)
    member = F.struct(F.col("l_partkey").alias("id"), F.concat(F.lit(" "), "l_returnflag", F.lit("*")).alias("partido"))
    return collect_members(lines, ["l_orderkey"], member, F.struct("l_partkey", "l_suppkey", "l_shipdate"), "partidos")


@query("a8_nested_conditional_counts", """
select l_orderkey, count(*) filter (l_returnflag = 'A') as qtd_esquerda,
       count(*) filter (l_returnflag = 'N') as qtd_direita, count(*) filter (l_returnflag = 'R') as qtd_centrao
from lineitem group by 1
""")
def a8_nested_conditional_counts(spark, sf_dir):
    counted = bloc_counts(order_members(spark, sf_dir), "partidos", "partido", FLAG_BLOCS, BLOC_COLUMNS)
    return sum_parts(counted, ["l_orderkey"], list(BLOC_COLUMNS.values()))


@query("a11_collect_structs", """
select l_orderkey, 0 as part, string_agg(l_partkey || ':' || ' ' || l_returnflag || '*', '|' order by l_partkey, l_returnflag) as members
from lineitem group by 1
""")
def a11_collect_structs(spark, sf_dir):
    shown = F.transform("partidos", lambda m: F.concat(m["id"].cast("string"), F.lit(":"), m["partido"]))
    return order_members(spark, sf_dir).select("l_orderkey", "part", F.array_join(shown, "|").alias("members"))


@query("f16_parse_struct_list", """
select l_orderkey, case when l_orderkey % 7 = 0 then 0 else count(*) end as n_members,
       case when l_orderkey % 7 = 0 then 0 else sum(l_partkey)::bigint end as id_sum
from lineitem group by l_orderkey
""")
def f16_parse_struct_list(spark, sf_dir):
    members = order_members(spark, sf_dir)
    shown = F.transform(
        "partidos",
        lambda m: F.concat(F.lit("{'id': "), m["id"].cast("string"), F.lit(", 'partido': '"), m["partido"], F.lit("'}")),
    )
    cell = F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    written = members.select("l_orderkey", F.when(F.col("l_orderkey") % 7 == 0, "not a list").otherwise(cell).alias("cell"))
    parsed = written.withColumn("members", text.parse_struct_list(F.col("cell")))
    ids = F.aggregate("members.id", F.lit(0).cast("long"), lambda s, i: s + i)
    return parsed.groupBy("l_orderkey").agg(
        F.sum(F.size("members")).alias("n_members"), F.sum(ids).alias("id_sum")
    )


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a9_describe", " union all ".join(f"""
select '{c}' as column_name, count({c}) as "count", round(avg({c}), 5) as mean, round(stddev_samp({c}), 5) as std,
       min({c}) as "min", round(quantile_cont({c}, 0.25), 5) as q1, round(quantile_cont({c}, 0.5), 5) as median,
       round(quantile_cont({c}, 0.75), 5) as q3, max({c}) as "max" from lineitem""" for c in NUMBERS))
def a9_describe(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "lineitem"), NUMBERS)
    return out.select(
        "column_name", "count", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min",
        *[F.round(c, 5).alias(c) for c in ("q1", "median", "q3")], "max",
    )


@query("a10_corr", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 8) as r from lineitem" for a in NUMBERS for b in NUMBERS
))
def a10_corr(spark, sf_dir):
    return stats.correlations(table(spark, sf_dir, "lineitem"), NUMBERS).withColumn("r", F.round("r", 8))


@query("a17_histogram30", """
with r as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders),
c as (select least(floor((o_totalprice - lo) / w) + 1, 30)::bigint as bin, count(*) as n from orders, r group by 1)
select b::bigint as bin, round(lo + (b - 1) * w, 6) as low, round(lo + b * w, 6) as high, coalesce(n, 0) as "count"
from r, range(1, 31) t(b) left join c on c.bin = b
""")
def a17_histogram30(spark, sf_dir):
    bins = stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30)
    return bins.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("a18_density", """
with v as (select c_acctbal as x, count(*) as c from customer group by 1),
r as (select min(c_acctbal) as lo, max(c_acctbal) as hi, stddev_samp(c_acctbal) * pow(count(*), -0.2) as h, count(*) as n from customer),
g as (select i::int as point, lo + i * ((hi - lo) / 199) as x from r, range(0, 200) t(i))
select point, round(g.x, 6) as x, round(sum(c * exp(-pow((v.x - g.x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) as density
from g, v, r group by point, g.x
""")
def a18_density(spark, sf_dir):
    curve = stats.density(table(spark, sf_dir, "customer"), "c_acctbal", 200)
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@query("a19_box_stats", """
with q as (
  select o_orderpriority, count(*) as n, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median,
         quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1
), j as (
  select orders.o_orderpriority as g, o_totalprice as x, q.*,
         o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
  from orders join q on orders.o_orderpriority = q.o_orderpriority
)
select g as o_orderpriority, any_value(n) as n, round(any_value(q1), 5) as q1, round(any_value(median), 5) as median,
       round(any_value(q3), 5) as q3, round(min(x) filter (inside), 5) as whisker_low,
       round(max(x) filter (inside), 5) as whisker_high, count(*) filter (not inside) as outliers
from j group by g
""")
def a19_box_stats(spark, sf_dir):
    box = stats.box_stats(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return box.select(
        "o_orderpriority", "n",
        *[F.round(c, 5).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers",
    )


@query("a20_distinct_sorted", "select distinct source from documents order by 1")
def a20_distinct_sorted(spark, sf_dir):
    return stats.distinct_sorted(table(spark, sf_dir, "documents"), "source")


@query("a21_cleaning_funnel", """
select 0 as step, 'all' as name, count(*) as "rows" from orders
union all select 1, 'finished', count(*) from orders where o_orderstatus in ('F', 'O')
union all select 2, 'priced', count(*) from orders where o_orderstatus in ('F', 'O') and o_totalprice > 100000
union all select 3, 'urgent', count(*) from orders
  where o_orderstatus in ('F', 'O') and o_totalprice > 100000 and nullif(o_orderpriority, '5-LOW') < '3'
""")
def a21_cleaning_funnel(spark, sf_dir):
    return stats.funnel(table(spark, sf_dir, "orders"), {
        "finished": F.col("o_orderstatus").isin("F", "O"),
        "priced": F.col("o_totalprice") > 100000,
        "urgent": F.nullif("o_orderpriority", F.lit("5-LOW")) < "3",
    })


@query("a22_minmax_scale", """
with c as (select source, count(*) as n from documents group by 1)
select source, n, round((n - min(n) over ())::double / nullif(max(n) over () - min(n) over (), 0), 8) as scaled from c
""")
def a22_minmax_scale(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return stats.min_max_scale(counts, "n").withColumn("scaled", F.round("scaled", 8))


@query("a12_ordered_listagg", """
select l_orderkey, string_agg(l_returnflag, ', ' order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as flags
from lineitem group by 1
""")
def a12_ordered_listagg(spark, sf_dir):
    lines = lines_by_order(spark, sf_dir).withColumn(
        "place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    )
    return stats.ordered_list(lines, "l_orderkey", "l_returnflag", ["place"], "flags")


@query("a13_distinct_listagg", """
select l_orderkey, string_agg(distinct l_returnflag, ', ' order by l_returnflag) as flags from lineitem group by 1
""")
def a13_distinct_listagg(spark, sf_dir):
    return stats.distinct_list(lines_by_order(spark, sf_dir), "l_orderkey", "l_returnflag", "flags")


TOKENS = """tokens as (
  select p_brand as cluster, unnest(string_split(p_name, ' ')) as token, unnest(range(0, 2)) as pos, p_partkey from part
), counted as (
  select cluster, token, count(*) as n, min(p_partkey * 2 + pos) as first_seen from tokens group by 1, 2
), summary as (
  select cluster, arg_min(token, (-n, first_seen)) as theme, max(n) as freq,
         round_even(max(n) / sum(n) * 100 * 100, 0) / 100 as pct
  from counted group by 1
)"""


def cluster_summary(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("cluster"), "p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "token")
    )
    return shares.mode_with_share(tokens, "cluster", "token", ["p_partkey", "pos"])


@query("a14_mode_share", f"with {TOKENS} select * from summary")
def a14_mode_share(spark, sf_dir):
    return cluster_summary(spark, sf_dir)


@query("a15_theme_rollup", f"""
with {TOKENS}
select theme, string_agg(cluster, '|' order by cluster) as clusters, sum(freq)::bigint as freq_total,
       round_even(sum(freq) * 100.0 / (select sum(freq) from summary) * 100, 0) / 100 as pct_total
from summary group by theme
""")
def a15_theme_rollup(spark, sf_dir):
    rolled = shares.theme_rollup(cluster_summary(spark, sf_dir))
    return rolled.withColumn("clusters", F.array_join("clusters", "|"))


@query("c14_assign_theme", f"""
with {TOKENS}
select p_partkey, p_brand as cluster, theme, freq, pct from part left join (select * from summary where freq > 10) s on p_brand = cluster
""")
def c14_assign_theme(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("cluster"))
    summary = cluster_summary(spark, sf_dir).where("freq > 10")
    return shares.assign_theme(rows, summary)


@query("w6_percent_of_total", f"""
with {TOKENS}
select cluster, token, n, round(n * 100.0 / sum(n) over (partition by cluster), 6) as pct_group,
       round(n * 100.0 / sum(n) over (), 6) as pct_all from counted
""")
def w6_percent_of_total(spark, sf_dir):
    counts = (
        table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("cluster"), F.explode(F.split("p_name", " ")).alias("token"))
        .groupBy("cluster", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = shares.percent_of_total(counts, "cluster", "n")
    return out.select("cluster", "token", "n", F.round("pct_group", 6).alias("pct_group"), F.round("pct_all", 6).alias("pct_all"))


@query("o1_sort_desc", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey
""")
def o1_sort_desc(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey")


@query("o2_argmax", """
with c as (select o_custkey, o_orderpriority, sum(o_totalprice) as s from orders group by 1, 2)
select o_custkey, arg_min(o_orderpriority, (-round(s, 2), o_orderpriority)) as best, round(max(s), 4) as score from c group by 1
""")
def o2_argmax(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    best = shares.arg_max(spent, ["o_custkey"], "o_orderpriority", F.round("s", 2), "best")
    return best.select("o_custkey", "best", F.round("score", 4).alias("score"))


@query("w5_head_per_group", """
select lang, doc_id, rank from (
  select lang, doc_id, (row_number() over (partition by lang order by doc_id))::int as rank from documents
) where rank <= 3
""")
def w5_head_per_group(spark, sf_dir):
    return shares.head_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 3)


@query("o4_head", "select doc_id, lang, source from documents order by doc_id limit 5")
def o4_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(5)


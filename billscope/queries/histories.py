"""Event histories (events per user) as periods and runs, and questions at a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from billscope.operators import intervals
from billscope.plans import composition
from billscope.queries.registry import query, table
from billscope.shared import settle

AS_OF = "2024-02-01"


def day():
    return F.col("ts").cast("date")


def as_of():
    return F.lit(AS_OF).cast("date")


def periods(spark, sf_dir):
    return intervals.open_close_periods(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], day(),
        opens=F.col("event_type").isin("signup", "purchase"),
        closes=F.col("event_type").isin("error", "purchase"),
        as_of=as_of(),
    )


def runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return intervals.value_runs(events, "user_id", ["ts", "event_id"], day(), "event_type", as_of=as_of(), place="place")


PERIODS_SQL = f"""marks as (
  select user_id, ts, event_id, ts::date as day,
         case event_type when 'signup' then 1 when 'error' then 0 end as s, (event_type = 'purchase')::int as t
  from events where event_type in ('signup', 'error', 'purchase')
), flips as (
  select *, sum(t) over (partition by user_id order by ts, event_id) as f from marks
), based as (
  select *, last_value(case when s is not null then (s + f) % 2 end ignore nulls)
              over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as b from flips
), states as (
  select *, (coalesce(b, 0) + f) % 2 as state from based
), steps as (
  select *, coalesce(lag(state) over (partition by user_id order by ts, event_id), 0) as before from states
), changes as (
  select user_id, day, state, lead(day) over (partition by user_id order by ts, event_id) as next_day from steps where state <> before
), periods as (
  select user_id, day as data_entrada, coalesce(next_day, date '{AS_OF}') as data_saida from changes where state = 1
)"""

RUNS_SQL = f"""e as (
  select user_id, ts, event_id, ts::date as day, nullif(event_type, 'view') as v,
         lag(nullif(event_type, 'view')) over (partition by user_id order by ts, event_id) as p from events
), heads as (
  select user_id, v, day, ts, event_id, lead(day) over (partition by user_id order by ts, event_id) as next_day
  from e where v is distinct from p
), runs as (
  select user_id, v as event_type, day as data_entrada_partido, coalesce(next_day, date '{AS_OF}') as data_saida_partido, ts, event_id
  from heads where v is not null
)"""


def shown(*names):
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


@query("w2_open_close_periods", f"""
with {PERIODS_SQL}
select user_id, strftime(data_entrada, '%Y-%m-%d') as data_entrada, strftime(data_saida, '%Y-%m-%d') as data_saida from periods
""")
def w2_open_close_periods(spark, sf_dir):
    return periods(spark, sf_dir).select("user_id", *shown("data_entrada", "data_saida"))


@query("w3_value_runs", f"""
with {RUNS_SQL}
select user_id, event_type, strftime(data_entrada_partido, '%Y-%m-%d') as data_entrada_partido,
       strftime(data_saida_partido, '%Y-%m-%d') as data_saida_partido from runs
""")
def w3_value_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "event_type", *shown("data_entrada_partido", "data_saida_partido"))


@query("w4_first_value_carry", """
select event_id, user_id, first_value(event_type) over (partition by user_id order by ts, event_id) as first_type from events
""")
def w4_first_value_carry(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = intervals.first_value_per_key(events, "user_id", ["ts", "event_id"], "event_type", "first_type")
    return out.select("event_id", "user_id", "first_type")


@query("o3_chronological_rank", """
select event_id, row_number() over (partition by user_id order by ts, event_id) as place from events
""")
def o3_chronological_rank(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return intervals.chronological_rank(events, "user_id", ["ts", "event_id"], "place").select("event_id", "place")


def event_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select(day().alias("data")).distinct()


@query("j8_active_on_date", f"""
with {PERIODS_SQL}, days as (select distinct ts::date as d from events)
select strftime(d, '%Y-%m-%d') as data, user_id, count(*) as n_periods
from periods join days on d between data_entrada and data_saida group by 1, 2
""")
def j8_active_on_date(spark, sf_dir):
    active = intervals.active_on(periods(spark, sf_dir), event_days(spark, sf_dir))
    return active.groupBy(F.date_format("data", "yyyy-MM-dd").alias("data"), "user_id").agg(
        F.count(F.lit(1)).alias("n_periods")
    )


@query("j8_orders_in_transit", """
with spans as (
  select o_orderkey, o_orderdate::date as a, max(l_shipdate)::date as b from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
), days as (select distinct date_trunc('month', o_orderdate)::date + 14 as d from orders)
select strftime(d, '%Y-%m-%d') as data, count(*) as in_transit from spans join days on d between a and b group by 1
""")
def j8_orders_in_transit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("b"))
    spans = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey).select("o_orderkey", "a", "b")
    days = orders.select(F.date_add(F.trunc("a", "MM"), 14).alias("data")).distinct()
    active = intervals.active_on(spans, days, start="a", end="b")
    return active.groupBy(F.date_format("data", "yyyy-MM-dd").alias("data")).agg(
        F.count(F.lit(1)).alias("in_transit")
    )


@query("j9_asof_first_match", f"""
with {RUNS_SQL}, asked as (select distinct user_id, ts::date as d from events),
found as (
  select a.user_id, a.d, arg_min(event_type, (ts, event_id)) as v
  from asked a join runs r on a.user_id = r.user_id and a.d between data_entrada_partido and data_saida_partido group by 1, 2
)
select strftime(a.d, '%Y-%m-%d') as data, a.user_id, coalesce(v, 'Não encontrado') as event_type
from asked a left join found f on a.user_id = f.user_id and a.d = f.d
""")
def j9_asof_first_match(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("user_id", day().alias("data")).distinct()
    out = intervals.first_match_on(asked, runs(spark, sf_dir), "user_id", "event_type", order=["place"])
    return out.select(F.date_format("data", "yyyy-MM-dd").alias("data"), "user_id", "event_type")


KIND_BLOCS = {"signup": "Esquerda", "purchase": "Direita", "error": "Centrão"}


@query("house_composition", f"""
with {PERIODS_SQL}, {RUNS_SQL}, days as (select distinct ts::date as d from events),
seats as (select d, user_id, row_number() over () as seat from periods join days on d between data_entrada and data_saida),
party as (
  select s.d, s.seat, arg_min(r.event_type, (r.ts, r.event_id)) as v
  from seats s left join runs r on s.user_id = r.user_id and s.d between r.data_entrada_partido and r.data_saida_partido group by 1, 2
)
select strftime(d, '%Y-%m-%d') as data, count(*) filter (v = 'signup') as qtd_esquerda,
       count(*) filter (v = 'purchase') as qtd_direita, count(*) filter (v = 'error') as qtd_centrao
from party group by d
""")
def house_composition(spark, sf_dir):
    """Users open on each day, by the bloc of the run they were in: the whole interval chain."""
    active = intervals.active_on(periods(spark, sf_dir), event_days(spark, sf_dir))
    parties = intervals.first_match_on(
        active.select("user_id", "data"), runs(spark, sf_dir), "user_id", "event_type",
        order=["place"],
    )
    member = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("partido"))
    members = intervals.collect_members(settle(parties), ["data"], member, F.col("user_id"), "partidos")
    counted = intervals.bloc_counts(members, "partidos", "partido", KIND_BLOCS, composition.BLOC_COLUMNS)
    summed = intervals.sum_parts(counted, ["data"], list(composition.BLOC_COLUMNS.values()))
    return summed.withColumn("data", F.date_format("data", "yyyy-MM-dd"))

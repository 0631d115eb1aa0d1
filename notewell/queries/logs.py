"""Weekly logs rendered from events, and calendar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import notes as N
from notewell.operators import xp
from notewell.sources import synth

TODAY = datetime.date(2024, 1, 25)


def _logs(spark, sf_dir):
    return N.parse(synth.vault(spark, sf_dir, "weekly-log"))


def xp_daily(spark, sf_dir):
    return xp.daily(_logs(spark, sf_dir))


def sleep_streak(spark, sf_dir):
    return xp.streak(xp.sleep_days(_logs(spark, sf_dir)), TODAY)


def xp_month(spark, sf_dir):
    return xp.totals(xp.points(_logs(spark, sf_dir), TODAY))


def iso_week(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.to_date("o_orderdate").alias("d")).select(text.iso_week_text(F.col("d")).alias("week"))
    return rows.groupBy("week").agg(F.count("*").alias("n")).withColumn("monday", F.date_format(text.iso_week_monday(F.col("week")), "yyyy-MM-dd"))


def month_days(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.dayofmonth(F.last_day("o_orderdate")).alias("days")).distinct()


QUERIES = {f.__name__: f for f in (xp_daily, sleep_streak, xp_month, iso_week, month_days)}

DAYS = """with e as (select strftime(ts, '%Y-%m-%d') as day, event_type from events),
  t as (select day, sum(case when event_type in ('purchase', 'signup') then 1 else -1 end)::bigint as tasks from e where event_type in ('purchase', 'signup', 'error') group by day),
  fw as (select strftime(ts, '%G-W%V') as week, strftime(date_trunc('week', ts)::date + 7, '%Y-%m-%d') as monday, count(*) filter (where event_type in ('purchase', 'signup')) as n from events group by all),
  bo as (select monday as day, 1::bigint as bonus from fw where n > 0 and week[-2:]::int % 2 = 0),
  sl as (select day from e group by day having count(*) filter (where event_type = 'click') % 5 <> 0),
  g as (select max(day::date) as last_gap from (select unnest(range(date '2023-11-01', date '2024-01-25', interval 1 day))::date as day) where strftime(day, '%Y-%m-%d') not in (select day from sl)),
  k as (select day from sl, g where day::date > last_gap and day::date <= date '2024-01-25'),
  r as (select day, least(row_number() over (order by day), 7)::int as rank from k)
"""
SQL = {
    "xp_daily": DAYS + "select coalesce(t.day, bo.day) as day, coalesce(tasks, 0) as tasks, coalesce(bonus, 0) as bonus from t full join bo on t.day = bo.day",
    "sleep_streak": DAYS + "select day, rank from r",
    "xp_month": DAYS + ", x as (select day, sum(xp) as xp from (select day, tasks as xp from t union all select day, rank from r union all select day, bonus from bo) group by day) select substr(day, 1, 7) as month, sum(xp)::bigint as xp, trunc(sum(xp) / 50)::bigint as level from x group by rollup (substr(day, 1, 7))",
    "iso_week": "with w as (select strftime(o_orderdate, '%G-W%V') as week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as monday from orders) select week, count(*) as n, min(monday) as monday from w group by week",
    "month_days": "select distinct strftime(o_orderdate, '%Y-%m') as month, day(last_day(o_orderdate))::int as days from orders",
}

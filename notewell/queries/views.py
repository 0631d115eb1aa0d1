"""View files over the rendered vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewell.operators import notes as N
from notewell.plans import base as B
from notewell.sources import synth

TICKETS = """
filters:
  and:
    - type == "ticket"
    - file.inFolder("41 projects")
    - "!template.isTruthy()"
formulas:
  per_item: if(items > 0, (cost / items).round(2), "")
  ratio: (cost / items).round(3)
  size: if(cost > 250000, "large", if(cost < 50000, "small", "medium"))
  doubled: cost * 2 - items
properties:
  note.status:
    displayName: State
views:
  - name: Open
    filters:
      and:
        - status == "open"
        - '!file.inFolder("41 projects/tracks")'
    order: [file.name, status, project, created]
    sort:
      - property: created
        direction: ASC
      - property: file.name
        direction: ASC
  - name: Done
    filters:
      and: [done == true]
    order: [file.name, cost]
  - name: Tagged
    filters:
      and:
        - tags.containsAny("urgent", "high")
    order: [file.name, kind]
  - name: Backlog
    filters:
      and:
        - "!status.isTruthy()"
    order: [file.name, status]
  - name: Blocked
    filters:
      and: [requires.length > 1]
    order: [file.name]
  - name: Either
    filters:
      or:
        - kind == "urgent"
        - requires.length > 0
    order: [file.name, kind]
  - name: Elsewhere
    filters:
      and:
        - '!file.inFolder("41 projects/BUILDING")'
        - done == false
    order: [file.name, file.folder]
  - name: Costs
    order: [file.name, formula.per_item]
  - name: Ratios
    order: [file.name, formula.ratio]
  - name: Sizes
    order: [file.name, formula.size]
  - name: Sums
    order: [file.name, formula.doubled]
  - name: Grouped
    order: [file.name]
    groupBy:
      property: status
      direction: DESC
    sort:
      - property: file.name
        direction: ASC
  - name: Totals
    order: [file.name, items, status, kind]
    summaries:
      items: Sum
      status: Average
      note.kind: Median
"""


def _view(view: str, names: list[str], kinds: tuple[str, ...] = ("ticket",)):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.run_files(B.parse(TICKETS), view, synth.vault(spark, sf_dir, *kinds))
        return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

    return query


def base_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each open ticket of a project in the order of the view."""
    rows = B.run_files(B.parse(TICKETS), "Open", synth.vault(spark, sf_dir, "ticket"))
    return rows.select(F.col("c0").alias("name"), F.row_number().over(Window.partitionBy("c2").orderBy(*B.sort_keys(rows))).alias("place"))


def base_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.run_files(B.parse(TICKETS), "Grouped", synth.vault(spark, sf_dir, "ticket"))
    return rows.groupBy(F.col("_group").alias("label")).agg(F.count("*").alias("n"), F.min("c0").alias("first_name"))


def base_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = B.parse(TICKETS)
    rows = B.run_files(base, "Totals", synth.vault(spark, sf_dir, "ticket"))
    return B.summaries(base, "Totals", rows).select(F.col("c1").alias("items_sum"), F.col("c2").alias("status_avg"), F.col("c3").alias("kind_other"))


def file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parse(synth.vault(spark, sf_dir, "ticket", "track"), keys=()).groupBy("type").agg(F.count("*").alias("n"))


QUERIES = {
    "base_open_view": _view("Open", ["name", "status", "project", "created"], ("ticket", "track")),
    "base_bool_filter": _view("Done", ["name", "cost"]),
    "base_contains_any": _view("Tagged", ["name", "kind"]),
    "base_truthy_backlog": _view("Backlog", ["name", "status"]),
    "base_length_gt": _view("Blocked", ["name"]),
    "base_or_filter": _view("Either", ["name", "kind"]),
    "base_not_in_folder": _view("Elsewhere", ["name", "folder"]),
    "base_formula_if_round": _view("Costs", ["name", "per_item"]),
    "base_formula_divzero": _view("Ratios", ["name", "ratio"]),
    "base_formula_compare": _view("Sizes", ["name", "size"]),
    "base_formula_arithmetic": _view("Sums", ["name", "doubled"]),
    "base_groupby": base_groupby,
    "base_sorted": base_sorted,
    "base_summary_sum_avg": base_summary,
    "file_count": file_count,
}

#: The tickets as the rendering states them, from the tables.
T = """with t as (
  select o_orderkey as k, 'ticket-' || o_orderkey as name, o_custkey, c_nationkey, c_mktsegment as seg, o_orderstatus as os, lower(replace(substr(o_orderpriority, 3), ' ', '-')) as kind,
    case when o_orderkey % 13 = 0 then '' when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'open' else 'abandoned' end as status,
    case when o_orderkey % 11 <> 0 then o_totalprice end as cost, o_orderkey % 4 as items, strftime(o_orderdate, '%Y-%m-%d') as created,
    case when o_orderkey % 17 = 0 then 'superseded' when o_orderkey % 19 = 0 then 'provisional' else 'certified' end as tier,
    o_orderkey % 101 = 0 as template, '41 projects/' || c_mktsegment || '/ticket-' || o_orderkey || '.md' as rel
  from orders join customer on o_custkey = c_custkey),
v as (select * from t where not template)
"""
#: A double as the text that the formulas give: no point for whole numbers.
NUM = "case when {x} is null then '' when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end"
PER = "case when items = 0 then 0.0 else round(cost / items * {s}) / {s} end"
SQL = {
    "base_open_view": T + "select name, status, seg as project, created from v where status = 'open'",
    "base_bool_filter": T + "select name, coalesce(cast(cost as varchar), '') as cost from v where os = 'F'",
    "base_contains_any": T + "select name, kind from v where kind in ('urgent', 'high')",
    "base_truthy_backlog": T + "select name, status from v where status = ''",
    "base_length_gt": T + "select name from v where k % 14 = 0",
    "base_or_filter": T + "select name, kind from v where kind = 'urgent' or k % 7 = 0",
    "base_not_in_folder": T + "select name, '41 projects/' || seg as folder from v where seg <> 'BUILDING' and os <> 'F'",
    "base_formula_if_round": T + f", n as (select name, items, round(cost / nullif(items, 0) * 100.0) / 100.0 as x from v) select name, case when items > 0 then {NUM.format(x='x')} else '' end as per_item from n",
    "base_formula_divzero": T + f", n as (select name, {PER.format(s='1000.0')} as x, cost from v) select name, case when cost is null then '' else {NUM.format(x='x')} end as ratio from n",
    "base_formula_compare": T + "select name, case when cost > 250000 then 'large' when cost < 50000 then 'small' else 'medium' end as size from v",
    "base_formula_arithmetic": T + f", n as (select name, cost * 2 - items as x from v) select name, {NUM.format(x='x')} as doubled from n",
    "base_sorted": T + "select name, row_number() over (partition by seg order by created, name, rel)::int as place from v where status = 'open'",
    "base_groupby": T + "select status as label, count(*) as n, min(name) as first_name from v group by status",
    "base_summary_sum_avg": T + "select cast(cast(sum(items) as bigint) as varchar) as items_sum, '' as status_avg, '' as kind_other from v",
    "file_count": "select 'ticket' as type, count(*) as n from orders union all select 'track', count(*) from nation",
}

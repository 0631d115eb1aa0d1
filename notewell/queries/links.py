"""Links, listings and resolution over the rendered vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import graph, lint
from notewell.operators import notes as N
from notewell.queries.views import T
from notewell.sources import synth


def _notes(spark: SparkSession, sf_dir: str, *kinds: str, parts: tuple[str, ...] = (), keys: tuple[str, ...] | None = ()) -> DataFrame:
    """Notes of which a query reads the canonical columns and some more keys of the frontmatter (None: all)."""
    return N.parse(synth.vault(spark, sf_dir, *kinds), *parts, keys=keys)


def tags_count(spark, sf_dir):
    return graph.tag_counts(_notes(spark, sf_dir, "ticket", "card"))


def files_by_tag(spark, sf_dir):
    return _notes(spark, sf_dir, "card").where(F.array_contains("tags", "promo")).select("rel")


def list_by_type(spark, sf_dir):
    return graph.listing(_notes(spark, sf_dir, "card", "ticket", keys=("size",)), "card", extra="size")


def list_live_tickets(spark, sf_dir):
    return graph.listing(_notes(spark, sf_dir, "ticket"), "ticket", drop_superseded=True)


def backlinks_count(spark, sf_dir):
    return graph.backlinks(_notes(spark, sf_dir, "ticket", "track", parts=("links",))).groupBy("name", "src_tier").agg(F.count("*").alias("n"))


def card_backlinks(spark, sf_dir):
    return graph.backlinks(_notes(spark, sf_dir, "ticket", "card", parts=("links",))).where("name like 'card-%' and src_name like 'ticket-%'").select("name", "src_name", "line")


def link_targets(spark, sf_dir):
    return graph.link_targets(_notes(spark, sf_dir, "card", parts=("links",), keys=None)).groupBy("rel").agg(F.count("*").alias("n"), F.min_by("target", "ord").alias("first_target"))


def resolve_slug(spark, sf_dir):
    return graph.resolve(_notes(spark, sf_dir, "track", "reference"), "Tracks/Track 7").select("rel")


def resolve_many(spark, sf_dir):
    needles = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("Track "), F.col("n_nationkey")).alias("needle"))
    return graph.resolve_many(_notes(spark, sf_dir, "track"), needles)


def in_folder_boundary(spark, sf_dir):
    return _notes(spark, sf_dir, "ticket", "track").where(text.in_folder(F.col("rel"), "41 projects/tr")| text.in_folder(F.col("rel"), "41 projects/tracks")).select("rel")


def ticket_by_track(spark, sf_dir):
    notes = _notes(spark, sf_dir, "ticket", keys=("track",))
    owner = F.regexp_replace(text.resolve_name(F.get(F.col("fm")["track"]["links"], F.lit(0))["target"]), "^track-", "")
    return notes.groupBy(owner.alias("slug")).agg(F.count("*").alias("n"))


def track_roster(spark, sf_dir):
    """Tickets of tracks that the vault doesn't have, with near matches by the slug's first part."""
    notes = _notes(spark, sf_dir, "ticket", "track", keys=("slug", "track"))
    return graph.roster_check(notes).select("rel", "slug", F.array_join("near", ",").alias("near"))


def projects_listing(spark, sf_dir):
    return graph.projects(_notes(spark, sf_dir, "ticket", "track"), "41 projects", ("track-1",)).groupBy("folder").agg(F.count("*").alias("n"))


def fm_entry_kinds(spark, sf_dir):
    return N.fm_entries(_notes(spark, sf_dir, "ticket", keys=None)).groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("seq_len").alias("seq_len"))


QUERIES = {f.__name__: f for f in (tags_count, files_by_tag, list_by_type, list_live_tickets, backlinks_count, card_backlinks, link_targets, resolve_slug, resolve_many, in_folder_boundary, ticket_by_track, track_roster, projects_listing, fm_entry_kinds)}

#: The cards as the rendering states them.
C = """c as (
  select p_partkey as k, 'card-' || p_partkey as name, '20 cards/card-' || p_partkey || '.md' as rel, p_name, lower(p_type) as t1, lower(replace(p_brand, '#', '-')) as t2, p_size,
    p_partkey % 21 = 0 as superseded from part)
"""
CT = T + ", " + C
SQL = {
    "tags_count": CT + """select tag, count(*) as n from (
      select kind as tag from t union all select lower(seg) from t union all select 'once-' || k from t where k % 5 = 0
      union all select t1 from c where k % 9 <> 0 union all select t2 from c where k % 9 <> 0) group by tag""",
    "files_by_tag": "with " + C + "select rel from c where t1 = 'promo' and k % 9 <> 0",
    "list_by_type": "with " + C + "select rel, case when superseded then '[superseded] ' else '' end || name || ' — ' || p_name || case when k % 9 = 0 then '' else ' [' || t1 || ', ' || t2 || ']' end || ' (size: ' || p_size || ')' as line from c",
    "list_live_tickets": T + "select rel, name || ' — Order ' || k || ' of customer ' || o_custkey || ' [' || kind || ', ' || lower(seg) || case when k % 5 = 0 then ', once-' || k else '' end || ']' as line from v where tier <> 'superseded'",
    "backlinks_count": T + "select 'track-' || c_nationkey as name, tier as src_tier, count(*) as n from t group by all",
    "card_backlinks": CT + """, l as (select name as src_name, o_custkey, k, 0 as again from t union all select name, o_custkey, k, 1 from t where k % 3 = 0)
      select c.name, l.src_name, (3 + 13 + case when l.k % 11 = 0 then -1 else 0 end + (l.k % 17 = 0)::int + (l.k % 101 = 0)::int + (l.k % 19 = 0)::int + (l.k % 23 = 0)::int - (l.k % 31 = 0)::int + (l.k % 101 = 0 or l.k % 37 = 0)::int + (l.k % 101 <> 0 and l.k % 43 = 0)::int + case when l.k % 14 = 0 then 3 when l.k % 7 = 0 then 2 else 0 end + 2 + again * 13)::int as line
      from l join c on c.k = l.o_custkey""",
    "link_targets": "with " + C + "select rel, 3 + case when k % 6 = 0 then 0 else 1 end + case when k * 3 = case when k % 25 = 24 then k else k + 1 end then -1 else 0 end as n, 'card-' || k * 3 as first_target from c",
    "resolve_slug": "select '41 projects/tracks/track-7.md' as rel from nation where n_nationkey = 7",
    "resolve_many": "select 'Track ' || n_nationkey as needle, '41 projects/tracks/track-' || n_nationkey || '.md' as rel from nation",
    "in_folder_boundary": "select '41 projects/tracks/track-' || n_nationkey || '.md' as rel from nation",
    "ticket_by_track": T + "select c_nationkey || case when k % 59 = 0 then '-old' else '' end as slug, count(*) as n from t group by 1",
    "track_roster": T + "select c_nationkey || '-old' as slug, rel, cast(c_nationkey as varchar) as near from t where k % 59 = 0",
    "projects_listing": T + "select '41 projects/' || seg as folder, count(*) as n from t group by 1 union all select '41 projects/tracks', count(*) from nation where n_nationkey <> 1",
    "fm_entry_kinds": T + """select key, kind, count(*) as n, sum(s) as seq_len from (
      select unnest(['type', 'description', 'project', 'kind', 'track', 'created']) as key, 'string' as kind, 0 as s from t
      union all select 'slug', 'string', 0 from t union all select 'items', 'number', 0 from t union all select 'done', 'bool', 0 from t
      union all select 'status', case when k % 13 = 0 then 'null' else 'string' end, 0 from t union all select 'tags', 'list', 2 + (k % 5 = 0)::int from t
      union all select 'cost', 'number', 0 from t where k % 11 <> 0 union all select 'superseded', 'bool', 0 from t where k % 17 = 0
      union all select 'template', 'bool', 0 from t where k % 101 = 0 union all select 'epistemic_status', 'string', 0 from t where k % 19 = 0
      union all select 'stage', case when k % 101 = 0 then 'list' else 'string' end, case when k % 101 = 0 then 2 else 0 end from t where k % 101 = 0 or k % 37 = 0
      union all select 'smell', 'string', 0 from t where k % 101 <> 0 and k % 43 = 0
      union all select 'colour', 'string', 0 from t where k % 23 = 0 union all select 'updated', 'string', 0 from t where k % 31 <> 0
      union all select 'requires', 'list', 1 + (k % 14 = 0)::int from t where k % 7 = 0) group by key, kind""",
}

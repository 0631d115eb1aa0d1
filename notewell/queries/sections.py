"""Sections, addresses, blocks and rewrites over the rendered vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import distill, sections
from notewell.operators import notes as N
from notewell.queries.views import T
from notewell.sources import synth


def _tickets(spark, sf_dir, *parts):
    return N.parse(synth.vault(spark, sf_dir, "ticket"), *parts)


def section_ranges(spark, sf_dir):
    rows = sections.ranges(sections.strict(_tickets(spark, sf_dir, "headings")))
    return rows.select("rel", "address", "level", "start", "end", "slug")


def line_owner(spark, sf_dir):
    """The section of each line that has one."""
    return sections.owned(_tickets(spark, sf_dir, "headings"))


def heading_addresses(spark, sf_dir):
    rows = sections.resolve(sections.ranges(_tickets(spark, sf_dir, "headings")), "notes")
    return rows.groupBy("address").agg(F.count("*").alias("n"))


def section_own_prose(spark, sf_dir):
    notes = _tickets(spark, sf_dir, "headings")
    return sections.own_prose(notes, sections.ranges(notes)).groupBy("address", "tokens", "own_tokens").agg(F.count("*").alias("n"))


def block_stats(spark, sf_dir):
    return N.part(_tickets(spark, sf_dir, "nodes"), "nodes").groupBy("type").agg(F.count("*").alias("n"))


def inline_stats(spark, sf_dir):
    return N.part(_tickets(spark, sf_dir, "inlines"), "inlines").groupBy("type").agg(F.count("*").alias("n"))


def blocks_tile(spark, sf_dir):
    """Top-level blocks that overlap: none."""
    nodes = N.part(_tickets(spark, sf_dir, "nodes"), "nodes").where("depth = 0").select("rel", "type", F.col("span.start").alias("start"), F.col("span.end").alias("end"))
    return sections.overlaps(nodes)


def disjoint_sections(spark, sf_dir):
    return distill.disjoint_sections(_tickets(spark, sf_dir, "headings")).select("rel", "seq", "heading", F.octet_length("text").alias("n_bytes"))


def density_route(spark, sf_dir):
    cards = N.parse(synth.vault(spark, sf_dir, "card"), "headings")
    routed = distill.route(distill.disjoint_sections(cards))
    return routed.groupBy("heading", "preserve").agg(F.count("*").alias("n"))


def harvest_lanes(spark, sf_dir):
    return distill.harvest(N.parse(synth.vault(spark, sf_dir, "card")), "rel", "body").groupBy("lane").agg(F.count("*").alias("n"))


def format_departures(spark, sf_dir):
    rows = _tickets(spark, sf_dir).select(distill.formatted(F.regexp_replace("content", "\n", "\r\n")).alias("f"))
    return rows.select(F.explode("f.departures").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (section_ranges, line_owner, heading_addresses, section_own_prose, block_stats, inline_stats, blocks_tile, disjoint_sections, density_route, harvest_lanes, format_departures)}

#: f: the lines of a ticket's frontmatter.
FRONT = T + """, l as (select *, 15 - (k % 11 = 0)::int + (k % 17 = 0)::int + (k % 101 = 0)::int + (k % 19 = 0)::int + (k % 23 = 0)::int - (k % 31 = 0)::int + (k % 101 = 0 or k % 37 = 0)::int + (k % 101 <> 0 and k % 43 = 0)::int + case when k % 14 = 0 then 3 when k % 7 = 0 then 2 else 0 end as f from t)"""
SQL = {
    "section_ranges": FRONT + """ select rel, '1' as address, 1 as level, f + 1 as start, f + 20 as "end", 'order-' || k as slug from l union all select rel, '1.1', 2, f + 10, f + 17, 'notes' from l
        union all select rel, '1.1.1', 3, f + 14, f + 17, 'detail' from l union all select rel, '1.2', 2, f + 18, f + 20, 'tasks' from l""",
    "line_owner": FRONT + " select rel, f + i as line, case when i < 10 then '1' when i < 14 then '1.1' when i < 18 then '1.1.1' else '1.2' end as address from l, range(1, 21) as r(i)",
    "heading_addresses": "select '1.1' as address, count(*) as n from orders",
    "section_own_prose": T + """, x as (select *, '## Notes' || e || e || 'First line.' || e || e as notes, '### Detail' || e || e || case when k % 3 = 0 then 'Again [[Card-' || o_custkey || '.md]].' else 'Nothing more.' end || e as detail, '## Tasks' || e || e || '- [ ] ship' as tasks,
          '# Order ' || k || e || e || 'See [[track-' || c_nationkey || ']] and [[card-' || o_custkey || '#Notes|card]].' || e || '`[[not-a-link]]` stays.' || e || e || '```' || e || '[[nor-this]]' || e || '```' || e as intro from (select *, chr(10) as e from t)),
        y as (select unnest(['1', '1.1', '1.1.1', '1.2']) as address, unnest([length(intro || e || notes || detail || e || tasks), length(notes || detail), length(detail), length(tasks)]) as a, unnest([length(intro), length(notes) - 1, length(detail), length(tasks)]) as b from x)
      select address, (a // 4)::int as tokens, (b // 4)::int as own_tokens, count(*) as n from y group by all""",
    "block_stats": "select unnest(['Paragraph', 'CodeBlock', 'List', 'ListItem']) as type, unnest([count(*) * 4, count(*), count(*), count(*)]) as n from orders",
    "inline_stats": "select 'Wikilink' as type, count(*) * 2 + count(*) filter (where o_orderkey % 3 = 0) as n from orders union all select 'CodeSpan', count(*) from orders",
    "blocks_tile": "select '' as rel, '' as type, 0 as start, 0 as \"end\" where false",
    "disjoint_sections": T + """ select rel, unnest([0, 1, 2, 3, 4]) as seq, unnest(['', 'Order ' || k, 'Notes', 'Detail', 'Tasks']) as heading, unnest([0,
        length('# Order ' || k) + 2 + length('See [[track-' || c_nationkey || ']] and [[card-' || o_custkey || '#Notes|card]].') + 1 + length('`[[not-a-link]]` stays.') + 2 + 3 + 1 + 12 + 1 + 3 + 1,
        22, 12 + case when k % 3 = 0 then length('Again [[Card-' || o_custkey || '.md]].') else 13 end + 1, 20]) as n_bytes from t""",
    "density_route": "select '' as heading, false as preserve, count(*) as n from part union all select 'Glossary' as heading, true as preserve, count(*) as n from part union all select 'Relations', false, count(*) from part",
    "harvest_lanes": "select 'wikilink' as lane, 3 * count(*) as n from part union all select 'row', 3 * count(*) from part union all select 'number', 2 * count(*) from part",
    "format_departures": "select 'endings' as rule, count(*) as n from orders",
}

"""Lint rules over the rendered vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import lint as L
from notewell.operators import notes as N
from notewell.queries.links import C, CT
from notewell.queries.views import T
from notewell.sources import synth


#: Rules that look at the notes from one side, which need no table of them.
ONE_SIDED = ("ticket-outward-only", "missing-required-field", "slug-filename-mismatch", "oversized-entry", "untagged-card", "reference-not-wikilink", "duplicate-h1", "untyped-entry", "filename-hygiene", "invalid-frontmatter", "unquoted-frontmatter-link")


def _rule(name: str, *kinds: str, parts: tuple[str, ...] = (), cap: int = L.CAP):
    def query(spark, sf_dir):
        files = synth.vault(spark, sf_dir, *kinds)
        notes = N.parse(files, *parts) if name in ONE_SIDED else L.parsed_once(files, *parts)
        return L.RULES[name][1](L.Vault(notes, cap=cap)).select("file", "message")

    return query


def lint_summary(spark, sf_dir):
    """All rules over tickets, tracks, cards and references."""
    notes = L.parsed_once(synth.vault(spark, sf_dir, "ticket", "track", "card", "reference"), *L.NARROW)
    return L.summary(L.findings(L.Vault(notes)))


def lint_invalid_frontmatter(spark, sf_dir):
    """The drafts whose frontmatter can't be read; what the reader says of it is its own wording."""
    return _rule("invalid-frontmatter", "draft")(spark, sf_dir).select("file", F.startswith("message", F.lit("invalid frontmatter: ")).alias("said"))


def relation_edges(spark, sf_dir):
    notes = N.parse(synth.vault(spark, sf_dir, "card"), "headings")
    return L.relations(notes).groupBy("rel_token", "endpoint_kind", "predicate").agg(F.count("*").alias("n"))


QUERIES = {
    "lint_broken_wikilink": _rule("broken-wikilink", "card", "reference", parts=("links",)),
    "lint_dangling_reference": _rule("dangling-reference", "card", "reference"),
    "lint_dangling_requires": _rule("dangling-requires-target", "ticket"),
    "lint_orphan_cards": _rule("orphan-card", "card", parts=("links",)),
    "lint_reference_vault_link": _rule("reference-vault-link", "card", "reference", parts=("links",)),
    "lint_reference_wrong_type": _rule("reference-wrong-type", "card", "reference"),
    "lint_reference_not_wikilink": _rule("reference-not-wikilink", "card"),
    "lint_ticket_links": _rule("ticket-outward-only", "ticket", parts=("links",)),
    "lint_unknown_field": _rule("unknown-field", "ticket"),
    "lint_invalid_enum": _rule("invalid-enum-value", "ticket"),
    "lint_missing_required": _rule("missing-required-field", "ticket", "card", "weekly-log"),
    "lint_slug_mismatch": _rule("slug-filename-mismatch", "ticket"),
    "lint_singleton_tags": _rule("singleton-tag", "ticket", "card"),
    "lint_oversized": _rule("oversized-entry", "note", cap=1000),
    "lint_untagged_card": _rule("untagged-card", "card"),
    "lint_unknown_rel": _rule("unknown-rel", "card", parts=("headings",)),
    "lint_dangling_relation": _rule("dangling-relation-label", "card", parts=("headings",)),
    "lint_callout_separator": _rule("callout-missing-separator", "draft", parts=("nodes",)),
    "lint_duplicate_h1": _rule("duplicate-h1", "draft", parts=("headings", "nodes")),
    "lint_filename_hygiene": _rule("filename-hygiene", "draft"),
    "lint_invalid_frontmatter": lint_invalid_frontmatter,
    "lint_singleton_filename": _rule("singleton-filename-mismatch", "draft"),
    "lint_unintended_emphasis": _rule("unintended-emphasis", "draft", parts=("inlines",)),
    "lint_unquoted_link": _rule("unquoted-frontmatter-link", "draft", parts=("unquoted",)),
    "lint_untyped": _rule("untyped-entry", "draft"),
    "lint_summary": lint_summary,
    "relation_edges": relation_edges,
}

LIVE = T + ", x as (select * from t where not template and tier <> 'superseded')"
CLIVE = "with " + C + ", x as (select * from c where not superseded)"
SQL = {
    "lint_broken_wikilink": CLIVE + """, n as (select count(*) as cards from part), s as (select count(*) as refs from supplier), l as (
        select rel, 'card-' || k * 3 as target, k * 3 >= cards as gone from x, n
        union select rel, 'card-' || nxt, nxt >= cards from (select *, case when k % 25 = 24 then k else k + 1 end as nxt from x), n
        union select rel, 'ref-' || k % 120, k % 120 >= refs from x, s
        union select rel, '30 references/ref-' || k % 150, k % 150 >= refs from x, s where k % 6 <> 0
        union select '30 references/ref-' || s_suppkey || '.md', 'nation-' || s_nationkey, true from supplier
        union select '30 references/ref-' || s_suppkey || '.md', 'card-' || s_suppkey, s_suppkey >= cards from supplier, n where s_suppkey % 5 = 0)
      select rel as file, 'broken wikilink [[' || target || ']]' as message from l where gone""",
    "lint_dangling_reference": "select '30 references/ref-' || s_suppkey || '.md' as file, 'reference ''ref-' || s_suppkey || ''' is not used by any card' as message from supplier where s_suppkey % 8 <> 0 and not exists (select 1 from part where p_partkey % 6 <> 0 and p_partkey % 150 = s_suppkey)",
    "lint_dangling_requires": LIVE + """, r as (select rel, 'ticket-' || k + 1 as target from x where k % 7 = 0 union all select rel, 'ticket-gone-' || k from x where k % 14 = 0)
      select rel as file, 'requires [[' || target || ']], which is no ticket' as message from r where target not in (select name from t)""",
    "lint_orphan_cards": CLIVE + "select rel as file, 'card ''' || name || ''' has no inbound wikilinks' as message from x where k not in (select k * 3 from c) and k not in (select case when k % 25 = 24 then k else k + 1 end from c)",
    "lint_reference_vault_link": "select '30 references/ref-' || s_suppkey || '.md' as file, 'reference links to vault entry [[card-' || s_suppkey || ']]' as message from supplier where s_suppkey % 5 = 0 and s_suppkey % 8 <> 0 and s_suppkey in (select p_partkey from part)",
    "lint_reference_wrong_type": CLIVE + "select rel as file, 'reference [[30 references/ref-' || k % 150 || ']] has type ''note''' as message from x join supplier on s_suppkey = k % 150 where k % 6 <> 0 and s_suppkey % 8 = 0",
    "lint_reference_not_wikilink": CLIVE + "select rel as file, 'reference is no wikilink: plain text' as message from x where k % 6 = 0",
    "lint_ticket_links": LIVE + "select rel as file, 'ticket links outward to [[' || unnest(['track-' || c_nationkey, 'card-' || o_custkey || '#Notes']) || ']]' as message from x",
    "lint_unknown_field": LIVE + """, a as (select bool_or(k % 11 <> 0) as cost, bool_or(k % 19 = 0) as epistemic_status, bool_or(k % 23 = 0) as colour, bool_or(k % 7 = 0) as requires from t where template),
      f as (select rel, unnest(list_filter([case when k % 11 <> 0 and not a.cost then 'cost' end, case when k % 19 = 0 and not a.epistemic_status then 'epistemic_status' end, case when k % 23 = 0 and not a.colour then 'colour' end, case when k % 7 = 0 and not a.requires then 'requires' end, case when k % 43 = 0 then 'smell' end], lambda y: y is not null)) as key from x, a where a.cost is not null)
      select rel as file, 'unknown field ''' || key || ''' for type ''ticket''' as message from f""",
    "lint_invalid_enum": LIVE + "select rel as file, '''rough'' is no option of ''stage''' as message from x where k % 37 = 0 and exists (select 1 from t where template)",
    "lint_missing_required": CT + """, m as (select rel, 'updated' as key, 'ticket' as type from v where tier <> 'superseded' and k % 31 = 0 union all select rel, 'tags', 'card' from c where not superseded and k % 9 = 0
        union all select '50 logs/' || w || '.md', unnest(['start', 'end']), 'weekly-log' from (select distinct strftime(ts, '%G-W%V') as w from events))
      select rel as file, 'missing required field ''' || key || ''' for type ''' || type || '''' as message from m""",
    "lint_slug_mismatch": LIVE + "select rel as file, 'file should be named ''ticket-x' || k || '''' as message from x where k % 29 = 0",
    "lint_singleton_tags": CT + """, g as (select kind as tag, rel from t union all select lower(seg), rel from t union all select 'once-' || k, rel from t where k % 5 = 0 union all select t1, rel from c where k % 9 <> 0 union all select t2, rel from c where k % 9 <> 0)
      select min(rel) as file, 'tag ''' || tag || ''' is used once' as message from g group by tag having count(*) = 1""",
    "lint_oversized": """with d as (select d.doc_id, d.lang, text, (1 + length(text)) // 4 as tokens from documents d left join (select doc_id, max(toxic) as toxic from labels group by doc_id) l on d.doc_id = l.doc_id where coalesce(toxic, 0) <> 1)
      select '10 notes/' || lang || '/note-' || doc_id || '.md' as file, 'note ''note-' || doc_id || ''' has about ' || tokens || ' tokens' as message from d where tokens > 1000""",
    "lint_untagged_card": CLIVE + "select rel as file, 'card ''' || name || ''' has no tags' as message from x where k % 9 = 0",
    "lint_unknown_rel": CLIVE + "select rel as file, 'unknown relation ''likes''' as message from x where k % 10 = 0",
    "lint_dangling_relation": CLIVE + "select rel as file, 'relation label ''Gamma'' is no local node' as message from x where k % 4 = 0",
    "relation_edges": "with " + C + """, e as (select 'subsumes' as rel_token, 'local' as endpoint_kind, null as predicate from c union all select case when k % 10 = 0 then 'likes' else 'part-of' end, 'file', 'always' from c)
      select rel_token, endpoint_kind, predicate, count(*) as n from e group by all""",
}

W = "with w as (select c_custkey as k, '60 drafts/draft' || case when c_custkey % 16 = 3 then '  ' when c_custkey % 16 = 11 then '’' else '-' end || c_custkey || '.md' as file, 'draft-' || c_custkey as name from customer) "
SQL |= {
    "lint_callout_separator": W + "select file, 'no separator after the callout in line 8' as message from w where k % 8 = 1",
    "lint_duplicate_h1": W + "select file, 'heading repeats the name ''' || name || '''' as message from w where k % 8 = 2",
    "lint_filename_hygiene": W + "select file, case when k % 16 = 3 then 'double-space' else 'smart-quote' end as message from w where k % 8 = 3",
    "lint_invalid_frontmatter": W + "select file, true as said from w where k % 8 = 4",
    "lint_singleton_filename": W + "select file, 'file should be named ''Scratchpad''' as message from w where k % 8 = 5",
    "lint_unintended_emphasis": W + "select file, 'line 6: emphasis may be unintended: ' || unnest(['*.ts and dist/*', '__init__', '___x___']) as message from w where k % 8 = 6",
    "lint_unquoted_link": W + "select file, 'quote [[card-' || k || ']] in frontmatter' as message from w where k % 8 = 7",
    "lint_untyped": W + "select file, '''' || name || ''' has no type field' as message from w where k % 4 = 0",
}

#: What single rules find among tickets, tracks, cards and references together.
SUMMED = {
    "broken-wikilink": "select * from (" + SQL["lint_broken_wikilink"] + ") union all select * from (" + LIVE + """, n as (select count(*) as cards from part), l as (
        select rel, 'card-' || o_custkey || '#Notes' as target, o_custkey >= cards as gone from x, n union all select rel, 'Card-' || o_custkey || '.md', o_custkey >= cards from x, n where k % 3 = 0
        union all select rel, 'the project', true from x union all select rel, 'an old track', true from x where k % 59 = 0
        union all select rel, 'ticket-' || k + 1, 'ticket-' || k + 1 not in (select name from t) from x where k % 7 = 0 union all select rel, 'ticket-gone-' || k, true from x where k % 14 = 0)
      select rel as file, target as message from l where gone) union all select n_name, unnest(['its project', 'its region']) from nation""",
    "dangling-reference": SQL["lint_dangling_reference"],
    "dangling-relation-label": SQL["lint_dangling_relation"],
    "dangling-requires-target": SQL["lint_dangling_requires"],
    "invalid-enum-value": SQL["lint_invalid_enum"],
    "missing-required-field": CT + ", m as (select rel from v where tier <> 'superseded' and k % 31 = 0 union all select rel from c where not superseded and k % 9 = 0) select rel as file, '' as message from m",
    "orphan-card": SQL["lint_orphan_cards"] + " and k not in (select s_suppkey from supplier where s_suppkey % 5 = 0) and k not in (select o_custkey from orders join customer on o_custkey = c_custkey)",
    "reference-not-wikilink": SQL["lint_reference_not_wikilink"],
    "reference-vault-link": SQL["lint_reference_vault_link"],
    "reference-wrong-type": SQL["lint_reference_wrong_type"],
    "singleton-tag": SQL["lint_singleton_tags"].replace(") select min(rel)", " union all select 'supplier', 'a reference' from supplier) select min(rel)").replace(")\n      select min(rel)", " union all select 'supplier', 'a reference' from supplier) select min(rel)"),
    "slug-filename-mismatch": SQL["lint_slug_mismatch"],
    "ticket-outward-only": SQL["lint_ticket_links"],
    "unknown-field": SQL["lint_unknown_field"],
    "unknown-rel": SQL["lint_unknown_rel"],
    "untagged-card": SQL["lint_untagged_card"],
}
SQL["lint_summary"] = "select * from (" + " union all ".join(f"select '{rule}' as rule, count(*) as n from ({sql})" for rule, sql in SUMMED.items()) + ") where n > 0"

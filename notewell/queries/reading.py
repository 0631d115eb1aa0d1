"""Addresses, overviews, frontmatter paths, checks and reviews over the rendered vault and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import decisions
from notewell.operators import lint as L
from notewell.operators import notes as N
from notewell.operators import reading as R
from notewell.operators import review as V
from notewell.operators import search as S
from notewell.operators import sections
from notewell.queries.links import C
from notewell.queries.search import D
from notewell.queries.sections import SQL as SECTIONS
from notewell.queries.views import T
from notewell.sources import synth
from notewell.sources.shared import fresh_path

#: The number that ends the name of a rendered note.
K = r"(\d+)\.md$"


def _notes(spark, sf_dir, kind, *parts):
    return N.parse(synth.vault(spark, sf_dir, kind), *parts)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fm_path(spark, sf_dir):
    return _notes(spark, sf_dir, "card", "fm_json").select("rel", R.at_path(F.col("fm_json"), "tags[1]").alias("x")).select("rel", "x.value", "x.error")


def fm_fields(spark, sf_dir):
    fields = _notes(spark, sf_dir, "ticket", "fields").select(F.explode("fields").alias("f"))
    return fields.groupBy("f.key").agg(F.count("*").alias("n"), F.sum("f.line").alias("lines"))


def overview_tree(spark, sf_dir):
    rows = R.overview(_notes(spark, sf_dir, "ticket", "headings"))
    return rows.groupBy("headings", F.get_json_object("json", "$[2].heading").alias("third")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("json", "$[0].tokens").cast("long")).alias("tokens"))


def unfolded(spark, sf_dir):
    notes = _notes(spark, sf_dir, "ticket", "headings")
    return R.unfold(notes, None, "1", threshold=12).select("rel", F.md5("text").alias("digest"))


def address_outcomes(spark, sf_dir):
    notes = _notes(spark, sf_dir, "ticket", "headings")
    asked = notes.select("rel", F.explode(F.array(*map(F.lit, ("1.1", "9.9", "Detail", "no such", "links", "fm.cost", "NOTES")))).alias("asked"))
    return R.addressed(asked, sections.ranges(notes)).groupBy("asked", "outcome").agg(F.count("*").alias("n"))


def structure_checks(spark, sf_dir):
    return R.check_structure(_notes(spark, sf_dir, "ticket", "headings", "nodes")).groupBy("check").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def read_target(spark, sf_dir):
    return R.read_target(_notes(spark, sf_dir, "card", "headings"), "Card 12#Relations")


def ndjson_lines(spark, sf_dir):
    rows = R.as_lines(_notes(spark, sf_dir, "card", "headings"), "headings")
    return rows.select(F.get_json_object("value", "$.rel").alias("rel"), F.json_array_length(F.get_json_object("value", "$.headings")).alias("headings"))


def consult_sections(spark, sf_dir):
    return S.best_sections(_notes(spark, sf_dir, "ticket", "headings"), ["ship", "tasks", "detail"], stem=False)


def unit_partition(spark, sf_dir):
    rows = V.units(_notes(spark, sf_dir, "ticket", "headings")).unionByName(V.units(_notes(spark, sf_dir, "card", "headings")))
    return rows.groupBy("unit", "heading", "depth").agg(F.count("*").alias("n"), F.sum((F.col("title") != "").cast("int")).alias("titled"), F.sum(F.col("preserve").cast("int")).alias("preserved"))


def prose_items(spark, sf_dir):
    items = V.list_items(_notes(spark, sf_dir, "card"), "rel", "body").unionByName(V.list_items(_notes(spark, sf_dir, "ticket"), "rel", "body"))
    return items.select("rel", "n", "heading", "depth", "item")


def prose_verdicts(spark, sf_dir):
    """Verdicts on the items of cards: covered with an anchor that stands, with one that doesn't, dropped, or none."""
    notes = _notes(spark, sf_dir, "card")
    items = V.list_items(notes, "rel", "body")
    k = F.regexp_extract("rel", K, 1).cast("long")
    said = items.where("n = 0").withColumn("grade", F.when(k % 4 == 0, "dropped").when(k % 4 < 3, "covered")).where("grade is not null")
    said = said.select("rel", "n", "grade", F.when(k % 4 == 1, F.concat(F.lit("that (Beta) | subsumes: Alpha "), k)).otherwise("it stands nowhere in there").alias("anchor"))
    outputs = notes.select("rel", F.concat(F.lit("We know **that Beta #subsumes: [Alpha] "), k, F.lit("** and more.")).alias("output"))
    return V.prose_residue(items, said, outputs, "rel")


def edge_residue(spark, sf_dir):
    notes = _notes(spark, sf_dir, "card").select("rel", "body")
    output = notes.withColumn("body", F.regexp_replace("body", r"\[\[ref-[^\]]*\]\]", ""))
    return V.edge_residue(V.edges(notes, "rel", "body"), V.edges(output, "rel", "body"), "rel")


def _concepts(notes):
    k = F.regexp_extract("rel", K, 1)
    return notes.select(F.col("rel").alias("file"), F.posexplode(F.array(F.concat(F.lit("Alpha "), k), F.lit("Beta"))).alias("ord", "term"))


def _edges(notes):
    return L.relations(notes).select(F.col("rel").alias("file"), F.col("from_label").alias("source"), F.col("rel_token").alias("rel"), F.col("endpoint").alias("to"))


def relation_attach(spark, sf_dir):
    notes = _notes(spark, sf_dir, "card", "headings")
    return V.attach(_concepts(notes), _edges(notes), "file").groupBy("term", "rel").agg(F.count("*").alias("n"))


def edge_endpoints(spark, sf_dir):
    notes = _notes(spark, sf_dir, "card", "headings")
    return V.resolve_endpoints(_edges(notes), _concepts(notes).withColumnRenamed("ord", "id"), "file")


def neighbour_notes(spark, sf_dir):
    """The notes nearest to each passage of the benchmark."""
    passages = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("candidate"), "text")
    return V.neighbours(_notes(spark, sf_dir, "note"), passages, fresh_path(spark, "neighbours"), k=3).select("candidate", "rank", F.round("score", 6).alias("score"))


def spell_checks(spark, sf_dir):
    k = F.col("p_partkey")
    before = F.concat("p_name", F.lit(" stands ⟦1⟧ here"))
    after = F.when(k % 5 == 0, before).when(k % 5 == 1, F.regexp_replace(before, "stands", "stnads")).when(k % 5 == 2, F.regexp_replace(before, "here$", "zqxj")).when(k % 5 == 3, F.concat(before, F.lit("\n"))).otherwise(F.regexp_replace(before, "⟦1⟧", "⟦2⟧"))
    return _table(spark, sf_dir, "part").select("p_partkey", V.check_spelling(before, after).alias("reason"))


def apply_gate(spark, sf_dir):
    k = F.regexp_extract("rel", K, 1).cast("long")
    after = F.when(k % 3 == 1, F.regexp_replace("body", "## Relations", "Relations")).when(k % 3 == 2, F.regexp_replace("body", r"\|its source", "")).otherwise(F.col("body"))
    pairs = _notes(spark, sf_dir, "card").select("rel", F.col("body").alias("before"), after.alias("after"))
    return V.gate(pairs, "rel").groupBy("spans", "headings", "fences", "breaks", "ok").agg(F.count("*").alias("n"))


def span_notation(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat("p_name", F.lit("  ["), k, F.lit(".."), k + 5, F.lit("] "))).when(k % 3 == 1, F.concat("p_name", F.lit(" "), k, F.lit(".."), k + 5)).otherwise(F.concat("p_name", F.lit(" ["), k, F.lit(".."), k + 5))
    x = V.split_span(line)
    return _table(spark, sf_dir, "part").select("p_partkey", x["text"].alias("text"), V.span_text(x["span"]).alias("span"))


def headwords(spark, sf_dir):
    path = F.concat(F.lit("20 cards/"), F.regexp_replace("p_name", " ", "_-"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    label = F.concat(F.lit(" `x` \n"), F.repeat(F.concat("p_name", F.lit("  ")), F.lit(12)))
    return _table(spark, sf_dir, "part").select("p_partkey", V.headword(path).alias("headword"), F.length(V.handle(label)).alias("handle_length"), F.substring(V.handle(label), 1, 8).alias("handle_start"))


def edge_grammars(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 2 == 0, F.concat(F.lit("Old house —Part  Of→ "), "p_name", F.lit(" (seen (twice))"))).otherwise(F.concat(F.lit("Old house refines:: "), "p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", V.parse_edge(line).alias("e")).select("p_partkey", "e.*")


def capital_names(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Yesterday Anna met "), F.initcap("p_name"), F.lit(". Anna left.")).alias("t"))
    return V.name_counts(words, "p_partkey", "t")


def capital_runs(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The house of "), F.initcap("p_name"), F.lit(" and Anna. Anna left Bert there.")).alias("t"))
    return V.name_runs(words, "p_partkey", "t").select("p_partkey", "sentence", "first", "run")


def trust_default(spark, sf_dir):
    notes = synth.vault(spark, sf_dir, "card", "note").select(V.with_trust(F.col("content")).alias("c"), F.length("content").alias("n"))
    return notes.groupBy(F.regexp_count("c", F.lit("(?m)^epistemic_status: provisional$")).alias("marks"), (F.length("c") - F.col("n")).alias("more")).agg(F.count("*").alias("n"))


def wording_guard(spark, sf_dir):
    """A sentence a part with code and lists, changed on each axis in turn, and in ways that are no difference."""
    k = F.col("p_partkey")
    before = F.concat(F.lit("Yesterday Anna met ⟦0⟧ at `x`.\n\n- one\n- - -\n\n~~~\ncode "), "p_name", F.lit("\n1. no list\n~~~\n"))
    after = F.when(k % 8 == 1, F.regexp_replace(before, "⟦0⟧", "it")).when(k % 8 == 2, F.regexp_replace(before, "code", "cod")).when(k % 8 == 3, F.concat(before, F.lit("\nThen came Bert."))).when(k % 8 == 4, F.regexp_replace(before, "- one", "1. one")).when(k % 8 == 5, F.concat(before, F.lit("\n"), F.repeat(F.lit("and so on "), F.lit(8)), F.lit(".")))
    after = after.when(k % 8 == 6, F.regexp_replace(before, "- one", "- one\n- two\n1. three")).when(k % 8 == 7, F.regexp_replace(before, "`x`", "y")).otherwise(before)
    rows = V.guard(_table(spark, sf_dir, "part").select("p_partkey", before.alias("before"), after.alias("after")), "p_partkey")
    return rows.groupBy("masks", "code", "names", "words", "lists", "ok").agg(F.count("*").alias("n"))


def assembled_notes(spark, sf_dir):
    parts = V.units(_notes(spark, sf_dir, "card", "headings"))
    drafts = parts.select("rel", "unit", F.concat(F.lit("draft "), F.col("unit").cast("string")).alias("draft"))
    return V.assemble(parts, drafts).select("rel", F.md5("text").alias("digest"))


def staged_edges(spark, sf_dir):
    notes = _notes(spark, sf_dir, "card", "headings")
    k = F.regexp_extract("file", K, 1).cast("long")
    verdicts = _concepts(notes).where(k % 2 == 0).select("file", "term", F.lit("new").alias("verdict"))
    rows = V.staged(V.attach(_concepts(notes), _edges(notes), "file"), verdicts, "file", L.RELATIONS)
    return rows.groupBy("rel", "off_registry", "verdict", "inconclusive").agg(F.count("*").alias("n"))


def _decided(spark, sf_dir):
    """A note a part with decisions: some with two ticks where one may be, an unknown verb, or a block that never ends."""
    k = F.col("p_partkey")
    tick = lambda c: F.when(c, F.lit("x")).otherwise(F.lit(" "))
    content = F.concat(
        F.lit("# Part\n\n<!-- interact: pick-one id=a -->\n\n- [x] keep "), "p_name", F.lit("\n- ["), tick(k % 3 == 0), F.lit("] drop it\n\n<!-- /interact -->\n\n<!-- interact: confirm-all id=b -->\n- [X] "),
        F.when(k % 5 == 0, F.lit("eat")).otherwise(F.lit("move")), F.lit(" all\n<!-- /interact -->\n"), F.when(k % 7 == 0, F.lit("\n<!-- interact: pick-any id=c -->\n- [ ] drop more\n")).otherwise(F.lit("")),
    )
    return N.parse(synth.parts(spark, sf_dir).select(F.concat(F.lit("p/"), k.cast("string"), F.lit(".md")).alias("rel"), content.alias("content")), "regions", "dangling")


def decision_errors(spark, sf_dir):
    return decisions.errors(_decided(spark, sf_dir), ("keep", "drop", "move"))


def decision_fired(spark, sf_dir):
    return decisions.fired(_decided(spark, sf_dir), ("keep", "drop", "move"))


QUERIES = {f.__name__: f for f in (
    decision_errors, decision_fired, wording_guard, assembled_notes, staged_edges,
    fm_path, fm_fields, overview_tree, unfolded, address_outcomes, structure_checks, read_target, ndjson_lines, consult_sections, unit_partition, prose_items, prose_verdicts, edge_residue, relation_attach,
    edge_endpoints, neighbour_notes, spell_checks, apply_gate, span_notation, headwords, edge_grammars, capital_names, capital_runs, trust_default,
)}

#: The parts of a ticket's body, as section_own_prose has them.
X = SECTIONS["section_own_prose"].split("y as (")[0].rstrip().rstrip(",")
SQL = {
    "fm_path": "with " + C + "select rel, case when k % 9 <> 0 then '\"' || t2 || '\"' end as value, case when k % 9 = 0 then 'no key ''tags''' end as error from c",
    "fm_fields": T + """, f as (select k, unnest(['type', 'slug', 'description', 'status', 'project', 'kind', 'track', 'tags', 'cost', 'items', 'done', 'superseded', 'template', 'epistemic_status', 'colour', 'stage', 'smell', 'created', 'updated', 'requires']) as key,
        unnest([1, 1, 1, 1, 1, 1, 1, 1, (k % 11 <> 0)::int, 1, 1, (k % 17 = 0)::int, (k % 101 = 0)::int, (k % 19 = 0)::int, (k % 23 = 0)::int, (k % 101 = 0 or k % 37 = 0)::int, (k % 101 <> 0 and k % 43 = 0)::int, 1, (k % 31 <> 0)::int, (k % 7 = 0)::int]) as has, unnest(range(20)) as i from t),
      l as (select key, has, 1 + sum(has) over (partition by k order by i) as line from f)
      select key, count(*) as n, sum(line)::bigint as lines from l where has = 1 group by key""",
    "overview_tree": X + " select 4 as headings, 'Detail' as third, count(*) as n, sum(length(intro || e || notes || detail || e || tasks) // 4)::bigint as tokens from x",
    "unfolded": X + " select rel, md5(intro || e || case when length(notes || detail) // 4 <= 12 then notes || detail else '1.1 Notes (' || length(notes || detail) // 4 || ')' end || e || tasks) as digest from x",
    "wording_guard": "select p_partkey % 8 <> 1 as masks, p_partkey % 8 <> 2 as code, p_partkey % 8 <> 3 as names, p_partkey % 8 <> 5 as words, p_partkey % 8 <> 4 as lists, p_partkey % 8 in (0, 6, 7) as ok, count(*) as n from part group by all",
    "assembled_notes": "with " + C + """select rel, md5('draft 1' || e || '## Glossary' || e || e || '| Term | Meaning |' || e || '| --- | --- |' || e || '| Alpha ' || k || ' | first |' || e || '| Beta | second |' || e || e || 'draft 3') as digest from (select *, chr(10) as e from c)""",
    "staged_edges": "with " + C + """, s as (select k, 'subsumes' as rel from c union all select k, case when k % 10 = 0 then 'likes' else 'part-of' end from c where k % 4 <> 0)
      select rel, rel = 'likes' as off_registry, case when k % 2 = 0 then 'new' end as verdict, k % 2 <> 0 as inconclusive, count(*) as n from s group by all""",
    "decision_errors": """select 'p/' || p_partkey || '.md' as rel, 3 as line, 'not one' as code from part where p_partkey % 3 = 0 union all select 'p/' || p_partkey || '.md', 11, 'unknown verb' from part where p_partkey % 5 = 0
      union all select 'p/' || p_partkey || '.md', 14, 'never closed' from part where p_partkey % 7 = 0""",
    "decision_fired": "select 'p/' || p_partkey || '.md' as rel, unnest(['a', 'b']) as id, unnest(['pick-one', 'confirm-all']) as kind, unnest(['keep', 'move']) as verb, unnest([p_name, 'all']) as target from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and p_partkey % 7 <> 0",
    "address_outcomes": "select asked, outcome, count(*) as n from (select unnest(['1.1', '9.9', 'Detail', 'no such', 'links', 'fm.cost', 'NOTES']) as asked, unnest(['found', 'out of range', 'found', 'no match', 'reserved', 'reserved', 'found']) as outcome from orders) group by all",
    "structure_checks": "select unnest(['order', 'gap', 'nesting', 'known', 'body']) as \"check\", unnest([8 * count(*), 10 * count(*), 2 * count(*), 7 * count(*), count(*)])::bigint as n, 0::bigint as bad from orders",
    "read_target": "select '20 cards/card-12.md' as rel, '2' as address from part where p_partkey = 12",
    "ndjson_lines": "with " + C + "select rel, 2 as headings from c",
    "consult_sections": "select '41 projects/' || c_mktsegment || '/ticket-' || o_orderkey || '.md' as rel, '1.2' as section from orders join customer on o_custkey = c_custkey",
    "unit_partition": """select unit, heading, depth, sum(n)::bigint as n, sum(titled)::bigint as titled, sum(preserved)::bigint as preserved from (
        select unnest([1, 2, 3]) as unit, unnest(['', 'Notes', 'Tasks']) as heading, unnest([0, 2, 2]) as depth, count(*) as n, count(*) as titled, 0 as preserved from orders
        union all select unnest([1, 2, 3]), unnest(['', 'Glossary', 'Relations']), unnest([0, 2, 2]), count(*), 0, unnest([0, count(*), 0]) from part) group by all""",
    "prose_items": "with " + C + """select rel, unnest([0, 1]) as n, 'Relations' as heading, 2 as depth,
      unnest(['Beta subsumes:: Alpha ' || k, case when k % 4 = 0 then 'Gamma' else 'Beta' end || ' ' || case when k % 10 = 0 then 'likes' else 'part-of' end || ':: [[card-' || case when k % 25 = 24 then k else k + 1 end || ']] (always)']) as item from c""",
    "prose_verdicts": "with " + C + "select rel, 0 as n, case k % 4 when 0 then 'dropped' when 2 then 'not anchored' else 'no verdict' end as reason from c where k % 4 <> 1 union all select rel, 1, 'no verdict' from c",
    "edge_residue": "with " + C + "select rel, '[[ref-' || k % 120 || '|its source]]' as markup, 'dropped' as reason from c",
    "relation_attach": "with " + C + "select 'Beta' as term, 'subsumes' as rel, count(*) as n from c union all select 'Beta', case when k % 10 = 0 then 'likes' else 'part-of' end, count(*) from c where k % 4 <> 0 group by all",
    "edge_endpoints": "with " + C + "select rel as file, 1 as from_id, 'subsumes' as rel, 0 as to_id from c",
    "neighbour_notes": D + r""", n as (select rel, regexp_extract_all(lower(title || ' ' || description || ' ' || body), '[\p{L}\p{N}]+') as ws from d where tier <> 'superseded'),
      p as (select rel, len(ws) as len, unnest(ws) as term from n), f as (select rel, len, term, count(*) as tf from p group by all),
      s as (select count(*) as docs, avg(len(ws)) as a from n), g as (select term, count(*) as df, any_value(docs) as docs, any_value(a) as a from f, s group by term),
      q as (select distinct item_id as candidate, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
      r as (select candidate, rel, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) as score from q join g using (term) join f using (term) group by candidate, rel),
      z as (select candidate, row_number() over (partition by candidate order by round(score, 9) desc, rel) as rank, score from r)
      select candidate, rank::int as rank, round(score, 6) as score from z where rank <= 3""",
    "spell_checks": "select p_partkey, case p_partkey % 5 when 2 then 'words' when 3 then 'lines' when 4 then 'masks' end as reason from part",
    "apply_gate": "select p_partkey % 3 <> 2 as spans, p_partkey % 3 <> 1 as headings, true as fences, true as breaks, p_partkey % 3 = 0 as ok, count(*) as n from part group by all",
    "span_notation": "select p_partkey, p_name || case when p_partkey % 3 = 2 then ' [' || p_partkey || '..' || p_partkey + 5 else '' end as text, case when p_partkey % 3 <> 2 then p_partkey || '..' || p_partkey + 5 end as span from part",
    "headwords": """with h as (select *, p_name || ' ' || p_partkey as words, 'x' || repeat(' ' || p_name, 12) as line from part)
      select p_partkey, upper(words[1]) || words[2:] as headword, (case when length(line) > 80 then length(rtrim(line[1:80])) + 1 else length(line) end)::int as handle_length, line[1:8] as handle_start from h""",
    "edge_grammars": "select p_partkey, 'Old house' as source, case when p_partkey % 2 = 0 then 'part-of' else 'refines' end as rel, p_name as \"to\", case when p_partkey % 2 = 0 then 'seen (twice)' end as predicate from part",
    "capital_names": """with w as (select unnest(string_split(p_name, ' ')) as x from part), c as (select upper(x[1]) || lower(x[2:]) as name, 1 as n, 1 as inside from w where length(x) > 1
        union all select unnest(['Yesterday', 'Anna', 'Anna']), 1, unnest([0, 1, 0]) from part) select name, sum(n)::bigint as n, sum(inside)::bigint as inside from c group by name""",
    "capital_runs": """with w as (select p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) as ws from part)
      select p_partkey, 0 as sentence, 3 as first, array_to_string(ws, ' ') as run from w where len(ws) > 1""",
    "trust_default": """with d as (select coalesce(quality, 1) as q from documents left join (select doc_id, min(quality) as quality from labels group by doc_id) using (doc_id)),
      x as (select case when q = 0 then 0 else 30 end as more from d union all select 30 from part) select 1 as marks, more, count(*) as n from x group by more""",
}

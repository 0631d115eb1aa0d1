"""Search and retrieval over the notes rendered from documents.  The oracles state the unstemmed variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import notes as N
from notewell.operators import index
from notewell.operators import search as S
from notewell.sources import synth
from notewell.sources.shared import fresh_path

QUERY = "thand ereat inon"


def _notes(spark, sf_dir):
    return N.parse(synth.vault(spark, sf_dir, "note"))


def bm25_topk(spark, sf_dir):
    scored = S.bm25(_notes(spark, sf_dir), S.query_terms(QUERY, stem=False), stem=False)
    return scored.orderBy(F.desc(F.round("score", 6)), "rel").limit(20).select("rel", F.round("score", 6).alias("score"))


def bm25_tier_rerank(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    hits = S.bm25(notes, S.query_terms(QUERY, stem=False), stem=False).join(notes.select("rel", "tier"), "rel")
    scaled = hits.select("rel", "tier", F.round(F.col("score") * text.multiplier(F.col("tier")), 6).alias("score"))
    return scaled.orderBy(F.desc("score"), "rel").limit(20)


def search_stemmed(spark, sf_dir):
    return S.search(_notes(spark, sf_dir), QUERY, limit=10)


def search_regex_lines(spark, sf_dir):
    rows = S.regex_lines(_notes(spark, sf_dir), r"[0-9]{3}", context=1)
    return rows.groupBy("rel").agg(F.count("*").alias("n"), F.sum(F.size("before") + F.size("after")).alias("n_context"), F.min("line").alias("first_line"))


def coverage_topk(spark, sf_dir):
    terms = S.query_terms(QUERY, stem=False)
    rows = _notes(spark, sf_dir).select("rel", F.round(S.coverage(terms, F.col("body"), stem=False), 6).alias("coverage"))
    return rows.where("coverage > 0")


def consult_gate(spark, sf_dir):
    hits = S.consult_hits(_notes(spark, sf_dir), QUERY, scope=("note",), stem=False)
    r = lambda c: F.round(c, 6).alias(c)
    return S.gate(hits, S.MODES["deliberate"]).select("n", r("top"), r("median"), r("max_top3"), F.coalesce("abstain_reason", F.lit("")).alias("abstain_reason"))


def consult_pack(spark, sf_dir):
    mode = S.Mode(0.3, 1.0, budget=2000, cap=900)
    hits = S.consult_hits(_notes(spark, sf_dir), QUERY, scope=("note",), stem=False)
    return S.pack(S.candidates(hits, mode), mode).select("rel", "tokens")


def tier_counts(spark, sf_dir):
    return _notes(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.sum(text.multiplier(F.col("tier"))).cast("decimal(18,1)").cast("double").alias("weight"))


def index_topk(spark, sf_dir):
    """The best notes by an index, of which each query reads its terms' blocks alone."""
    made = index.build(_notes(spark, sf_dir), fresh_path(spark, "index"), stem=False)
    hits = index.top(made, S.parse_query(QUERY, stem=False), 20, S.BOOSTS)
    return hits.select("rel", F.round("score", 6).alias("score"))


def index_boolean(spark, sf_dir):
    """Conditions and trust, by an index: scores are scaled before the cut."""
    made = index.build(_notes(spark, sf_dir), fresh_path(spark, "index"), stem=False)
    hits = index.top(made, S.parse_query("es NOT el", stem=False), 20, S.BOOSTS, F.col("tier") != "superseded", scaled=True)
    return hits.select("rel", "tier", F.round("score", 6).alias("score"))


def best_windows(spark, sf_dir):
    """The window of each body that holds most of the terms."""
    notes = _notes(spark, sf_dir).where("rlike(lower(body), 'thand|ereat|inon')")
    return S.snippets(notes.select("rel", "body"), S.query_terms(QUERY, stem=False), width=60)


QUERIES = {f.__name__: f for f in (index_topk, index_boolean, best_windows, bm25_topk, bm25_tier_rerank, search_stemmed, search_regex_lines, coverage_topk, consult_gate, consult_pack, tier_counts)}

D = """with d as (
  select doc_id, '10 notes/' || lang || '/note-' || doc_id || '.md' as rel, case when toxic = 1 then 'superseded' when quality = 0 then 'provisional' else 'certified' end as tier, chr(10) || text as body,
    'note-' || doc_id as title, 'Note ' || doc_id || ' in ' || lang as description
  from documents left join (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id) using (doc_id)),
m as (select *, case tier when 'superseded' then 0.3 when 'provisional' then 0.6 else 1.0 end as mult from d)
"""


def _scores(where: str = "true", terms: str = "'thand', 'ereat', 'inon'") -> str:
    return D + f""", w as (select rel, tier, mult, body, field, boost, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') as ws from (
    select rel, tier, mult, body, unnest(['title', 'description', 'body']) as field, unnest([1.0, 1.5, 1.0]::double[]) as boost, unnest([title, description, body]) as x from m where {where})),
  q as (select unnest([{terms}]) as term),
  tf as (select rel, tier, mult, body, field, boost, term, len(ws) as n, len(list_filter(ws, lambda y: y = term)) as tf from w, q),
  st as (select field, term, count(*) as docs, avg(n) as avg_n, count(*) filter (where tf > 0) as df from tf group by field, term),
  s as (select rel, tier, mult, any_value(body) as body, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) as score from tf join st using (field, term) where tf > 0 group by rel, tier, mult)
"""


TOP = _scores("tier <> 'superseded'") + """, h as (select rel, score * mult as score, length(ltrim(body, chr(10))) // 4 as tokens,
    len(list_filter(['ereat', 'inon', 'thand'], lambda t: list_contains(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+'), t))) / 3.0 as coverage from s order by s.score desc, rel limit 20),
  r as (select *, row_number() over (order by score desc, rel) as rank from h)
"""
SQL = {
    "index_topk": _scores() + "select rel, round(score, 6) as score from s order by round(score, 9) desc, rel limit 20",
    "index_boolean": _scores(terms="'es', 'el'") + """, t as (select rel, tier, mult, sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) as score from tf join st using (field, term) where tf > 0 and term = 'es' group by all),
      no as (select distinct rel from tf where term = 'el' and tf > 0)
      select rel, tier, round(score * mult, 6) as score from t where tier <> 'superseded' and rel not in (select rel from no) order by round(score * mult, 9) desc, rel limit 20""",
    "best_windows": D + r""", b as (select rel, body, regexp_extract_all(body, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') as ps from d where regexp_matches(lower(body), 'thand|ereat|inon')),
      p as (select rel, unnest(ps) as piece, generate_subscripts(ps, 1) as i from b), o as (select rel, piece, coalesce(sum(length(piece)) over (partition by rel order by i rows between unbounded preceding and 1 preceding), 0)::int as a from p),
      mt as (select rel, a, a + length(piece) as z, case when starts_with(lower(piece), 'ereat') then 'ereat' when starts_with(lower(piece), 'inon') then 'inon' else 'thand' end as term from o where regexp_matches(lower(piece), '^(ereat|inon|thand)')),
      w as (select x.rel, x.a, any_value(x.z) as own, count(distinct y.term) as u, count(y.term) as n, max(y.z) as last from mt x left join mt y on x.rel = y.rel and y.a >= x.a and y.z <= x.a + 60 group by x.rel, x.a),
      r as (select *, row_number() over (partition by rel order by u desc, n desc, a) as k from w)
      select rel, substring(body, coalesce(greatest(0, a - least(20, greatest(0, a + 60 - coalesce(last, own)))), 0)::int + 1, 60) as snippet from b left join (select * from r where k = 1) r using (rel)""",
    "bm25_topk": _scores() + "select rel, round(score, 6) as score from s order by round(score, 6) desc, rel limit 20",
    "bm25_tier_rerank": _scores() + "select rel, tier, round(score * mult, 6) as score from s order by round(score * mult, 6) desc, rel limit 20",
    "search_regex_lines": D + """, n as (select rel, string_split('---' || chr(10) || 'type: note' || chr(10) || 'description: ' || description || chr(10) || 'x' || chr(10) || case when tier = 'superseded' or doc_id in (select doc_id from labels where toxic = 1) then 'x' || chr(10) else '' end || case when doc_id in (select doc_id from labels where quality = 0) then 'x' || chr(10) else '' end || '---' || body, chr(10)) as ls from d),
      e as (select rel, case when ls[len(ls)] = '' then ls[1:len(ls) - 1] else ls end as ls from n), g as (select rel, len(ls) as total, unnest(ls) as line, generate_subscripts(ls, 1) as i from e)
      select rel, count(*) as n, sum(least(1, i - 1) + least(1, total - i)) as n_context, min(i) as first_line from g where regexp_matches(line, '[0-9]{3}') group by rel""",
    "coverage_topk": D + """, c as (select rel, len(list_filter(['ereat', 'inon', 'thand'], lambda t: list_contains(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+'), t))) as n from d)
      select rel, round(n / 3.0, 6) as coverage from c where n > 0""",
    "consult_gate": TOP + """select count(*) as n, round(max(score), 6) as top, round(median(score), 6) as median, round(max(coverage) filter (where rank <= 3), 6) as max_top3,
      case when count(*) = 0 then 'no hits' when max(coverage) filter (where rank <= 3) < 0.45 then 'low coverage' when count(*) > 1 and max(score) < 1.5 * median(score) then 'no score elbow' else '' end as abstain_reason from r""",
    "consult_pack": "with recursive " + TOP.removeprefix("with ") + """, g as (select median(score) as med from r), c as (select r.*, score >= med as above from r, g where coverage >= 0.3),
      o as (select rel, tokens, row_number() over (order by rank) as i from c where above or rank <= 3 and not (select bool_or(above) from c)),
      f(i, used, rel, tokens, taken) as (select 0::bigint, 0::bigint, '', 0::bigint, false
        union all select o.i, f.used + case when o.tokens <= 900 and f.used + o.tokens <= 2000 then o.tokens else 0 end, o.rel, o.tokens, o.tokens <= 900 and f.used + o.tokens <= 2000 from f join o on o.i = f.i + 1)
      select rel, tokens::int as tokens from f where taken""",
    "tier_counts": D + "select tier, count(*) as n, round(sum(mult), 1) as weight from m group by tier",
}

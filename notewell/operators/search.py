"""Full-text search: postings, BM25, trust tiers, regex lines, and budgeted retrieval with an abstain gate."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.functions.stem import beginning, stemmed
from notewell.functions.stem import stem as stem_word
from notewell.sources.shared import written

BOOSTS = {"title": 1.0, "description": 1.5, "body": 1.0}
K1, B = 1.2, 0.75


def tokens(column: Column, stem: bool) -> Column:
    words = F.regexp_extract_all(F.lower(text.shown(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return stemmed(words) if stem else words


def matching(words: Column, terms: list[str], stem: bool) -> Column:
    """Of the words those that may be one of the terms, stemmed if asked for; only words that begin as a term's words do are stemmed."""
    if not stem:
        return F.filter(words, lambda w: w.isin(terms))
    begins = sorted({beginning(t) for t in terms})
    same = (lambda w: F.translate(w, "ё", "е")) if any("е" in b for b in begins) else (lambda w: w)
    return stemmed(F.filter(words, lambda w: text.any_of([F.startswith(same(w), F.lit(b)) for b in begins])))


def fields(notes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return notes.select("rel", *carry, F.col("name").alias("_f_title"), F.col("description").alias("_f_description"), F.col("body").alias("_f_body"))


@dataclass(frozen=True)
class Query:
    """A query: terms that make a score, those that must and those that must not be there.

    Terms side by side are alternatives.  ``a AND b`` asks for both sides, ``NOT a`` rules a term out, and ``OR`` says
    what is meant anyway; AND binds closer than OR, so a query is a list of conjunctions.
    """

    groups: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]

    @property
    def terms(self) -> list[str]:
        return sorted({t for wanted, _ in self.groups for t in wanted})

    def holds(self, has) -> Column:
        """The condition, where ``has`` gives that of one term."""
        parts = [reduce(and_, [*[has(t) for t in wanted], *[~has(t) for t in barred]]) for wanted, barred in self.groups]
        return reduce(or_, parts) if parts else F.lit(False)


def parse_query(query: str, stem: bool = True) -> Query:
    """The query; an operator of the query language that is left without a side is an error."""
    words = re.findall(r"[^\W_]+", text.sanitize_query(query))

    def term(word: str) -> str:
        return stem_word(word.lower()) if stem else word.lower()

    groups: list[tuple[list[str], list[str]]] = []
    at, join = 0, False
    while at < len(words):
        word, barred = words[at], False
        if word in ("AND", "OR"):
            if not groups or join or at + 1 == len(words) or words[at + 1] in ("AND", "OR"):
                raise ValueError(f"{word} needs terms on its sides")
            join = word == "AND"
            at += 1
            word = words[at]
        if word == "NOT":
            if at + 1 == len(words) or words[at + 1] in ("AND", "OR", "NOT"):
                raise ValueError("NOT needs a term")
            at, barred = at + 1, True
            word = words[at]
        if not join and not (barred and groups and not words[at - 2 : at - 1] == ["OR"]):
            groups.append(([], []))
        groups[-1][barred].append(term(word))
        join = False
        at += 1
    if any(not wanted for wanted, _ in groups):
        raise ValueError("NOT alone rules out without asking for anything")
    return Query(tuple((tuple(dict.fromkeys(a)), tuple(dict.fromkeys(b))) for a, b in groups))


def query_terms(query: str, stem: bool = True) -> list[str]:
    """The distinct terms that make a query's score."""
    return parse_query(query, stem).terms


CARRIED = ("name", "type", "tier", "tokens", "body")


def _scored(notes: DataFrame, query: Query, stem: bool, boosts: dict[str, float] | None, carry: tuple[str, ...]) -> DataFrame:
    """(rel, score, carry...) of the notes that a query holds for; the notes are parsed and cut into terms once.

    Only the query's terms leave a document: its terms are counted in its own row, and nothing is shuffled but sums; no
    postings list is made.  The statistics and the scores read one table in the shared folder: the counts of each note
    and, of those that hold, the columns that the caller carries on.
    """
    boosts, terms = boosts or BOOSTS, query.terms
    asked = sorted({*terms, *(t for _, barred in query.groups for t in barred)})
    cut = fields(notes, carry).select("rel", *carry, *[tokens(F.col(f"_f_{f}"), stem=False).alias(f"_w_{f}") for f in boosts])
    counted = cut.select("rel", *carry, *[F.size(f"_w_{f}").alias(f"len_{f}") for f in boosts], *[matching(F.col(f"_w_{f}"), asked, stem).alias(f"_t_{f}") for f in boosts])
    count = lambda f, t: F.size(F.filter(f"_t_{f}", lambda w: w == t))
    rows = counted.select("rel", *carry, *[f"len_{f}" for f in boosts], *[count(f, t).alias(f"tf_{f}_{i}") for f in boosts for i, t in enumerate(asked)])
    has = lambda t: text.any_of([F.col(f"tf_{f}_{asked.index(t)}") > 0 for f in boosts])
    rows = rows.withColumn("hit", query.holds(has)).select("rel", *[F.when(F.col("hit"), F.col(c)).alias(c) for c in carry], *[c for c in rows.columns if c not in ("rel", *carry)], "hit")
    # The statistics and the scores ask for other columns, so an exchange of theirs wouldn't be shared.
    rows = written(rows, "scored-notes")
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in boosts], *[F.sum((F.col(f"tf_{f}_{i}") > 0).cast("int")).alias(f"df_{f}_{i}") for f in boosts for i in range(len(asked))])
    score: Column = F.lit(0.0)
    for f, boost in boosts.items():
        norm = K1 * (1 - B + B * F.col(f"len_{f}") / F.col(f"avg_{f}"))
        for t in terms:
            i = asked.index(t)
            tf, df = F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}")
            idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
            score = score + F.when(tf > 0, boost * idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    # One row of statistics: a broadcast of constant size.
    return rows.join(F.broadcast(stats)).where("hit").select("rel", score.alias("score"), *carry)


def bm25(notes: DataFrame, terms: list[str] | Query, stem: bool = True, boosts: dict[str, float] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(rel, score, carry...) of the notes that hold a term: the sum over fields and terms of boost * idf * saturated tf.

    Statistics are those of the notes given, so a scope narrows them first.
    """
    query = terms if isinstance(terms, Query) else Query(tuple(((t,), ()) for t in terms))
    if not query.groups:
        return notes.select("rel", F.lit(0.0).alias("score"), *carry).limit(0)
    return _scored(notes, query, stem, boosts, carry)


def search(notes: DataFrame, query: str, limit: int = 10, types: tuple[str, ...] = (), drop_superseded: bool = False, stem: bool = True) -> DataFrame:
    """(rel, title, type, score, tokens, superseded, body, snippet, links): scores are scaled by trust before the limit.

    ``links``, the distinct targets of body and frontmatter, are there if the notes have their links.
    """
    rows = notes.where(F.col("type").isin(*types)) if types else notes
    if "links" in rows.columns:
        rows = rows.withColumn("_links", F.array_sort(F.array_distinct(F.concat(F.transform("links", lambda x: x["target"]), F.transform(F.flatten(F.transform(F.map_values("fm"), lambda v: v["links"])), lambda x: x["target"])))))
    asked = parse_query(query, stem)
    hits = bm25(rows, asked, stem, carry=(*CARRIED, *(c for c in ("_links",) if c in rows.columns)))
    if drop_superseded:
        hits = hits.where("tier <> 'superseded'")
    scaled = hits.withColumn("score", F.col("score") * text.multiplier(F.col("tier")))
    return described(scaled.orderBy(F.desc("score"), "rel").limit(limit), asked.terms)


def described(hits: DataFrame, terms: list[str]) -> DataFrame:
    """What a search says of its hits, a row a note; there are no more of them than its limit, and they are found once."""
    hits = written(hits, "search-hits")
    body = F.regexp_replace("body", r"^\n+", "")
    more = [F.col("_links").alias("links")] if "_links" in hits.columns else []
    rows = hits.select("rel", F.col("name").alias("title"), "type", "score", "tokens", (F.col("tier") == "superseded").alias("superseded"), body.alias("body"), *more)
    return rows.join(snippets(rows.select("rel", "body"), terms), "rel").orderBy(F.desc("score"), "rel")


def snippets(hits: DataFrame, terms: list[str], width: int = 150) -> DataFrame:
    """(rel, snippet): of each body (rel, body) the ``width`` characters that hold the most distinct terms.

    Windows begin at words that begin with a term; of those with as many distinct terms the one with the most matches
    counts, then the first.  The snippet begins a third of the width before it where the window leaves room, else as
    far as it does; a body without a match gives its beginning.  Windows slide over the matches of one body, as ranges
    of characters.
    """
    start = F.substring("body", 1, width)
    if not terms:
        return hits.select("rel", start.alias("snippet"))
    pieces = hits.select("rel", F.posexplode(F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))).alias("i", "piece"))
    ahead = Window.partitionBy("rel").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0)))
    term = F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.startswith(F.lower("piece"), t)), F.lit(0))
    matches = placed.select("rel", "at", (F.col("at") + F.length("piece")).alias("stop"), term.alias("term")).where("term is not null")
    # A match counts if it ends within the window, so windows are over the places of the ends.
    near = Window.partitionBy("rel").orderBy("at").rangeBetween(0, width - 1)
    inside = F.filter(F.collect_list(F.struct("at", "stop", "term")).over(near), lambda m: m["stop"] <= F.col("at") + width)
    counted = matches.withColumn("inside", inside)
    ranked = counted.select("rel", "at", F.size(F.array_distinct(F.transform("inside", lambda m: m["term"]))).alias("distinct"), F.size("inside").alias("n"), F.coalesce(F.array_max(F.transform("inside", lambda m: m["stop"])), F.col("stop")).alias("last"))
    best = ranked.groupBy("rel").agg(F.max_by(F.struct("at", "last"), F.struct("distinct", "n", -F.col("at"))).alias("w"))
    room = F.least(F.lit(width // 3), F.greatest(F.lit(0), F.col("w.at") + width - F.col("w.last")))
    return hits.join(best, "rel", "left").select("rel", F.coalesce(F.substring("body", (F.greatest(F.lit(0), F.col("w.at") - room) + 1).cast("int"), F.lit(width)), start).alias("snippet"))


def regex_lines(notes: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """(rel, line, text, before, after) of each line that matches, with up to ``context`` lines on either side."""
    if len(pattern) > 1 << 16:
        raise ValueError("the pattern is too long")
    rows = notes.select("rel", text.lines(F.col("content")).alias("lines"))
    rows = rows.where(F.exists("lines", lambda x: x.rlike(pattern))).select("rel", "lines", F.posexplode("lines").alias("i", "text")).where(F.col("text").rlike(pattern))
    at = F.col("i") + 1
    first = F.greatest(F.lit(1), at - context)
    return rows.select("rel", at.alias("line"), "text", F.slice("lines", first, at - first).alias("before"), F.slice("lines", at + 1, F.lit(context)).alias("after"))


def regex_counts(notes: DataFrame, pattern: str) -> DataFrame:
    return regex_lines(notes, pattern).groupBy("rel").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Mode:
    coverage: float
    elbow: float
    threshold: float | None = None
    budget: int = 8000
    cap: int = 4000


#: How sure a deliberate and an ambient call must be.
MODES = {"deliberate": Mode(0.45, 1.5), "ambient": Mode(0.50, 1.8)}
DEPTH = 20


def coverage(terms: list[str], body: Column, stem: bool = True) -> Column:
    """The part of the query's terms that a body has."""
    if not terms:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, terms)), tokens(body, stem))) / F.lit(float(len(terms)))


def consult_hits(notes: DataFrame, query: str, scope: tuple[str, ...] = (), include_superseded: bool = False, stem: bool = True) -> DataFrame:
    """The top hits of the scope, cut at DEPTH by raw score, then scaled by trust: (rel, score, rank, coverage, tokens, body)."""
    rows = notes.where(~F.col("is_template"))
    rows = rows.where(F.col("type").isin(*scope)) if scope else rows
    rows = rows if include_superseded else rows.where("tier <> 'superseded'")
    asked = parse_query(query, stem)
    terms = asked.terms
    top = bm25(rows, asked, stem, carry=CARRIED).orderBy(F.desc("score"), "rel").limit(DEPTH)
    body = F.regexp_replace("body", r"^\n+", "")
    hits = top.select("rel", "type", (F.col("score") * text.multiplier(F.col("tier"))).alias("score"), coverage(terms, F.col("body"), stem).alias("coverage"), text.tokens(body).alias("tokens"), (F.col("tier") == "superseded").alias("superseded"), body.alias("body"))
    # At most DEPTH rows are left; one window over them is of constant size.
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rel")))


def gate(hits: DataFrame, mode: Mode) -> DataFrame:
    """One row: n, top, median, max_top3, elbow_ratio, abstain_reason (null: selected).  Threshold, coverage, elbow, in this order."""
    g = hits.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.median("score").alias("median"), F.max(F.when(F.col("rank") <= 3, F.col("coverage"))).alias("max_top3"))
    reason = F.when(F.col("n") == 0, "no hits")
    if mode.threshold is not None:
        reason = reason.when(F.col("top") < mode.threshold, "below threshold")
    reason = reason.when(F.coalesce("max_top3", F.lit(0.0)) < mode.coverage, "low coverage").when((F.col("n") > 1) & (F.col("top") < mode.elbow * F.col("median")), "no score elbow")
    return g.select("n", "top", "median", "max_top3", F.when((F.col("n") > 1) & (F.col("median") > 0), F.col("top") / F.col("median")).alias("elbow_ratio"), reason.alias("abstain_reason"))


def candidates(hits: DataFrame, mode: Mode) -> DataFrame:
    """Hits at or above the median that cover enough; if there are none, those of the top three that do."""
    g = hits.agg(F.median("score").alias("_median"))
    enough = hits.join(F.broadcast(g)).where(F.col("coverage") >= mode.coverage).withColumn("_above", F.col("score") >= F.col("_median"))
    some = F.max(F.col("_above").cast("int")).over(Window.partitionBy()) == 1
    return enough.withColumn("_some", some).where((F.col("_some") & F.col("_above")) | (~F.col("_some") & (F.col("rank") <= 3))).drop("_median", "_above", "_some")


def pack(hits: DataFrame, mode: Mode) -> DataFrame:
    """(rel, score, tokens, rank): whole bodies in order of score while they fit; one that doesn't is passed over.

    A running sum can't pass over rows, so the at most DEPTH candidates are folded in one array.
    """
    listed = hits.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "rel", "score", "tokens"))).alias("all"))
    fold = F.expr(f"""aggregate(all, struct(0L as used, cast(array() as array<struct<rank:int,rel:string,score:double,tokens:int>>) as kept),
      (s, h) -> if(h.tokens <= {mode.cap} and s.used + h.tokens <= {mode.budget}, struct(s.used + h.tokens as used, array_append(s.kept, h) as kept), s))""")
    return listed.select(F.explode(fold["kept"]).alias("h")).select("h.rel", "h.score", "h.tokens", "h.rank")


def best_sections(notes: DataFrame, terms: list[str], stem: bool = True) -> DataFrame:
    """(rel, section): the section whose own lines hold most of the terms; of several the deepest, then the first.

    ``notes`` have their headings; a line counts for the deepest section that holds it.  Notes without a section, or
    without a term in one, have no row.
    """
    from notewell.operators import sections

    # A line looks for its section among the headings of its own row, so the notes are read once and nothing is joined.
    rows = sections.strict(notes).where(F.size("headings") > 0).select("rel", "headings", F.posexplode(text.lines(F.col("content"))).alias("i", "t"))
    rows = rows.withColumn("n", F.size(F.filter(tokens(F.col("t"), stem), lambda w: w.isin(*terms)))).where("n > 0")
    holds = F.filter("headings", lambda h: F.col("i").between(h["sec_start"] - 1, h["sec_end"] - 1))
    owner = F.array_max(F.transform(holds, lambda h: F.struct(h["level"].alias("level"), h["sec_start"].alias("start"), h["address"].alias("address"))))
    counted = rows.select("rel", "n", owner.alias("o")).where("o is not null").groupBy("rel", "o").agg(F.sum("n").alias("n"))
    return counted.groupBy("rel").agg(F.max_by("o.address", F.struct("n", "o.level", -F.col("o.start"))).alias("section"))


@dataclass
class Outcome:
    """Selected documents with pointers to the candidates left out, or the near misses and a reason."""

    reason: str | None
    docs: DataFrame | None
    pointers: DataFrame | None
    near_misses: DataFrame | None
    diagnostics: dict
    query: str = ""

    @property
    def exit_code(self) -> int:
        return 4 if self.reason else 0


def consult(notes: DataFrame, query: str, mode: Mode = MODES["deliberate"], scope: tuple[str, ...] = (), include_superseded: bool = False) -> Outcome:
    """Whole documents that fit the budget, or none; a query that can't be read is none, with its error as the reason."""
    try:
        hits = consult_hits(notes, query, scope, include_superseded)
    except ValueError as e:
        return Outcome(str(e), None, None, None, {"query_error": str(e)}, query)
    state = gate(hits, mode).first()
    diagnostics = {"top_score": state.top, "median_score": state.median, "coverage": mode.coverage, "max_top3_coverage": state.max_top3, "elbow_ratio": state.elbow_ratio, "num_returned": state.n, "query_error": None}
    if state.abstain_reason:
        return Outcome(state.abstain_reason, None, None, near_misses(hits, query), diagnostics, query)
    chosen = candidates(hits, mode)
    docs = pack(chosen, mode)
    left = chosen.join(docs.select("rel"), "rel", "left_anti")
    if "headings" in notes.columns:
        # At most DEPTH notes are left over; only their lines are looked at.
        near = best_sections(notes.join(F.broadcast(left.select("rel")), "rel", "left_semi"), query_terms(query))
        left = left.join(near, "rel", "left")
    return Outcome(None, chosen.join(docs.select("rel"), "rel", "left_semi"), left, None, diagnostics, query)


def _rows(df: DataFrame | None) -> list[dict]:
    """The rows of an outcome's tables, DEPTH at most, best first."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (-r["score"], r["rel"])) if df is not None else []


def _title(rel: str) -> str:
    return rel.rsplit("/", 1)[-1].removesuffix(".md")


def record(outcome: Outcome, mode: str, form: str, duration_ms: int, timestamp_ms: int) -> dict:
    """What a call leaves in the log: when, how long, what was asked, what the gate saw, and what came of it."""
    docs, pointers, misses = _rows(outcome.docs), _rows(outcome.pointers), _rows(outcome.near_misses)
    seen = dict.fromkeys(("top_score", "median_score", "coverage", "max_top3_coverage", "elbow_ratio", "num_returned", "query_error")) | outcome.diagnostics
    return {
        "timestamp_ms": timestamp_ms, "duration_ms": duration_ms, "query": outcome.query, "mode": mode, "format": form,
        "outcome": "abstain" if outcome.reason else "selected", "reason": outcome.reason, **seen, "num_selected": len(docs),
        "total_tokens": sum(d["tokens"] for d in docs), "selected_paths": [d["rel"] for d in docs], "num_pointers": len(pointers),
        "pointer_paths": [d["rel"] for d in pointers], "near_miss_titles": [_title(m["rel"]) for m in misses], "near_miss_scores": [m["score"] for m in misses],
    }


LOG_SCHEMA = """timestamp_ms long, duration_ms long, query string, mode string, format string, outcome string, reason string, top_score double, median_score double, coverage double,
  max_top3_coverage double, elbow_ratio double, num_returned long, query_error string, num_selected long, total_tokens long, selected_paths array<string>, num_pointers long,
  pointer_paths array<string>, near_miss_titles array<string>, near_miss_scores array<double>"""


def render_consult(outcome: Outcome, form: str = "markdown") -> str:
    """An outcome as markdown, whole documents one after the other, or as JSON."""
    docs, pointers, misses = _rows(outcome.docs), _rows(outcome.pointers), _rows(outcome.near_misses)
    if form == "json":
        doc = lambda d: {"title": _title(d["rel"]), "path": d["rel"], "score": d["score"], "tokens": d["tokens"], "body": d["body"]}
        point = lambda d: {"title": _title(d["rel"]), "path": d["rel"], "tokens": d["tokens"], "coverage": d["coverage"], "section": d.get("section")}
        miss = lambda d: {"title": _title(d["rel"]), "path": d["rel"], "score": d["score"], "matched": d["matched"]}
        head = {"status": "abstain" if outcome.reason else "selected", "query": outcome.query}
        rest = {"reason": outcome.reason, "near_misses": [miss(d) for d in misses]} if outcome.reason else {"total_tokens": sum(d["tokens"] for d in docs), "docs": [doc(d) for d in docs], "pointers": [point(d) for d in pointers]}
        return json.dumps(head | rest, ensure_ascii=False, indent=2)
    if outcome.reason:
        lines = [f"<!-- consult: nothing is sure enough ({outcome.reason}) -->", ""]
        lines += [f"- {_title(d['rel'])} ({d['rel']}): {', '.join(d['matched']) or 'no term'}" for d in misses] or ["Nothing comes near; ask in broader terms."]
        return "\n".join(lines) + "\n"
    lines = [f"<!-- consult: {len(docs)} documents, about {sum(d['tokens'] for d in docs)} tokens -->"]
    for d in docs:
        lines += ["", f"## {_title(d['rel'])}{' [superseded]' if d.get('superseded') else ''} ({d['rel']})", "", d["body"].rstrip()]
    if pointers:
        lines += ["", "Left out for their size; read them where they are:", ""]
        lines += [f"- {_title(d['rel'])}: read \"{d['rel']}\"{' ' + d['section'] if d.get('section') else ''} (about {d['tokens']} tokens, coverage {d['coverage']:.2f})" for d in pointers]
    return "\n".join(lines) + "\n"


def render_search(hits: DataFrame, form: str = "text") -> str:
    """Hits as text, as paths alone, or as JSON; there are no more of them than the search's limit."""
    rows = [r.asDict() for r in hits.collect()]
    if form == "paths":
        return "".join(f"{r['rel']}\n" for r in rows)
    if form == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    return "".join(f"{r['score']:.2f}  {'[superseded] ' if r['superseded'] else ''}{r['title']} ({r['rel']})\n      {' '.join(r['snippet'].split())}\n" for r in rows)


def near_misses(hits: DataFrame, query: str, stem: bool = True) -> DataFrame:
    """(rel, score, matched): the top three with the terms that they have, sorted."""
    terms = F.array(*map(F.lit, query_terms(query, stem))).cast("array<string>")
    return hits.where("rank <= 3").select("rel", "score", F.array_sort(F.array_intersect(terms, tokens(F.col("body"), stem))).alias("matched"))


def append_log(record: DataFrame, path: str) -> bool:
    """Appends a record, a row of LOG_SCHEMA; a log that can't be written never changes a call's result."""
    try:
        record.write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001
        print(f"the log was not written: {e}")
        return False
    return True

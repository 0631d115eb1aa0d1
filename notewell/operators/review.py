"""Reviewing a rewrite: units of a note, what must be covered, edges and their endpoints, and checks of single blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewell.functions import payload, text
from notewell.operators import distill

ITEMS = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("norm", T.StringType())]))


@F.pandas_udf(ITEMS)
def _items(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [{"heading": h, "depth": d, "item": x, "norm": n} for h, d, x, n in payload.list_items(s or "")])


def containment(column: str | Column) -> Column:
    """Texts in the form in which one is looked for in another: without marks, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), r"[`*_>#|\[\]()!~-]+", " "), r"\s+", " "))


def units(notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(rel, unit, title, heading, depth, text, density, preserve): the top-level units of notes.

    A leading heading of level 1 is the note's title; what stands below it, if anything, is its introduction, a unit of
    depth 0.  A heading opens a unit unless it is deeper than the one that opened the unit before it.  The depth of an
    open unit is the smallest so far, so openers and units are a running minimum and a running sum.
    """
    rows = distill.disjoint_sections(notes).where((F.col("seq") > 0) | F.col("text").rlike(r"\S"))
    by_seq = Window.partitionBy("rel").orderBy("seq")
    first = F.row_number().over(by_seq) == 1
    titled = first & (F.col("depth") == 1) & F.col("text").rlike(r"^#\s")
    rows = rows.withColumn("_titled", titled).withColumn("title", F.max(F.when(F.col("_titled"), F.trim(F.substring_index("text", "\n", 1)))).over(Window.partitionBy("rel")))
    rest = F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("")
    rows = rows.withColumn("text", F.when(F.col("_titled"), rest).otherwise(F.col("text"))).withColumn("heading", F.when(F.col("_titled"), "").otherwise(F.col("heading"))).withColumn("depth", F.when(F.col("_titled"), 0).otherwise(F.col("depth")))
    rows = rows.where(~F.col("_titled") | F.col("text").rlike(r"\S"))
    before = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.min(F.when(F.col("depth") > 0, F.col("depth"))).over(before)
    opener = (F.col("depth") == 0) | anchor.isNull() | (F.col("depth") <= anchor)
    rows = rows.withColumn("_opener", opener.cast("int")).withColumn("unit", F.sum("_opener").over(by_seq))
    head = F.min_by(F.struct("heading", "depth"), "seq")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("rel", "unit").agg(F.max("title").alias("title"), head.alias("h"), joined.alias("text")).select("rel", "unit", F.coalesce("title", F.lit("")).alias("title"), "h.heading", "h.depth", "text")
    return distill.route(out, threshold)


def list_items(docs: DataFrame, key: str, column: str, claimed: DataFrame | None = None) -> DataFrame:
    """(key, n, heading, depth, item): list items below headings that carry prose, those that ``claimed`` texts hold left out.

    Wrapped items are one; items in fences, before the first heading, without words besides links and code, or of
    fewer than 12 characters aren't claims.  ``claimed`` has (key, claim).
    """
    rows = docs.select(key, F.posexplode(_items(column)).alias("n", "x")).select(key, "n", "x.*")
    if claimed is not None:
        own = claimed.select(key, containment("claim").alias("c")).groupBy(key).agg(F.collect_set("c").alias("claims"))
        rows = rows.join(own, key, "left").where(~F.coalesce(F.exists("claims", lambda c: F.contains(c, F.col("norm"))), F.lit(False)))
    return rows.select(key, "n", "heading", "depth", "item")


def edges(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, slug, target, markup): wikilinks and internal links of texts, by the slug of what they name."""
    found = distill.harvest(docs, key, column).where("lane in ('wikilink', 'internal')")
    return found.select(key, text.slug_segment(text.strip_md(F.element_at(F.split("item", "/"), -1))).alias("slug"), F.col("item").alias("target"), "markup").where("slug <> ''")


def edge_residue(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """(key, markup, reason): edges of the source that its output doesn't have.

    Where different targets share a slug, an edge of the output may be either's; all of them come back, as collisions.
    Spellings of one target, by case or alias, are no collision, and come back once.
    """
    grouped = source.groupBy(key, "slug").agg(F.count_distinct(F.lower(F.trim("target"))).alias("targets"), F.array_sort(F.collect_set("markup")).alias("markups"))
    clash = grouped.where("targets > 1").select(key, F.explode("markups").alias("markup"), F.lit("collision").alias("reason"))
    lost = grouped.where("targets = 1").join(output.select(key, "slug").distinct(), [key, "slug"], "left_anti").select(key, F.get("markups", F.lit(0)).alias("markup"), F.lit("dropped").alias("reason"))
    return clash.unionByName(lost)


def prose_residue(items: DataFrame, verdicts: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, n, reason): items that a verdict doesn't clear.

    ``verdicts`` has (key, n, grade, anchor), ``outputs`` (key, output).  Only a verdict of ``covered`` clears an item,
    and only if its anchor, of 16 characters at least, stands in the output and shares two content words with the item.
    """
    content = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 3))
    said = verdicts.select(key, "n", "grade", containment("anchor").alias("_a"))
    rows = items.join(said, [key, "n"], "left").join(outputs.select(key, containment("output").alias("_out")), key, "left")
    anchored = (F.length("_a") >= 16) & F.contains("_out", F.col("_a")) & (F.size(F.array_intersect(content("item"), content("_a"))) >= 2)
    reason = F.when(F.col("grade").isNull(), "no verdict").when(F.col("grade") == "dropped", "dropped").when((F.col("grade") != "covered") | ~F.coalesce(anchored, F.lit(False)), "not anchored")
    return rows.withColumn("reason", reason).where("reason is not null").select(key, "n", "reason")


def plain_relation(rel: Column) -> Column:
    """A relation's name: plain signs, lower case, blanks as hyphens; null if nothing is left."""
    signs = F.translate(rel, "‘’“”«»–—", "''\"\"\"\"--")
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(signs, r"\s+", " "))), " ", "-"), F.lit(""))


def normal_edges(rows: DataFrame) -> DataFrame:
    """Rows with ``rel`` and ``to`` in their plain forms; an edge without either goes, an empty predicate is none."""
    to = F.nullif(F.trim(F.translate("to", "‘’“”«»–—", "''\"\"\"\"--")), F.lit(""))
    out = rows.withColumn("rel", plain_relation(F.col("rel"))).withColumn("to", to)
    if "predicate" in rows.columns:
        out = out.withColumn("predicate", F.nullif(F.trim("predicate"), F.lit("")))
    return out.where(F.col("rel").isNotNull() & F.col("to").isNotNull())


def parse_edge(line: Column) -> Column:
    """(source, rel, to, predicate) of ``a —rel→ b (p)`` or ``a rel:: b (p)``; null where it is neither.

    The predicate is what the last closing bracket holds, with brackets within it.
    """
    arrow = r"^(.*?)\s*(?:—|--|-)\s*([\w -]+?)\s*(?:→|->)\s*(.+)$"
    words = F.split(F.trim(F.substring_index(line, "::", 1)), r"\s+")
    is_arrow, is_colon = line.rlike(arrow), line.contains("::")
    source = F.when(is_arrow, F.regexp_extract(line, arrow, 1)).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    rel = F.when(is_arrow, F.regexp_extract(line, arrow, 2)).otherwise(F.element_at(words, -1))
    right = F.trim(F.when(is_arrow, F.regexp_extract(line, arrow, 3)).otherwise(F.regexp_extract(line, r"^.*?::(.*)$", 1)))
    # Two levels of brackets, which is as deep as a regular expression of fixed size goes.
    bracket = r"\(((?:[^()]|\([^()]*\))*)\)$"
    has = right.rlike(bracket)
    to = F.trim(F.when(has, F.regexp_replace(right, bracket, "")).otherwise(right))
    predicate = F.when(has, F.nullif(F.trim(F.regexp_extract(right, bracket, 1)), F.lit("")))
    edge = F.struct(F.nullif(F.trim(source), F.lit("")).alias("source"), plain_relation(rel).alias("rel"), to.alias("to"), predicate.alias("predicate"))
    return F.when((is_arrow | is_colon) & (to != "") & plain_relation(rel).isNotNull(), edge)


def attach(concepts: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, term, rel, to): relations with the concept that they begin at.

    ``concepts`` has (key, ord, term), ``relations`` (key, source, rel, to).  A source names the first concept with its
    slug; a relation without one belongs to a note's only concept, and to none where there are more.
    """
    c = concepts.select(key, "ord", "term", text.slug_segment(F.col("term")).alias("slug"))
    first = c.groupBy(key, "slug").agg(F.min_by("term", "ord").alias("term"))
    only = c.groupBy(key).agg(F.count("*").alias("_c"), F.min("term").alias("term")).where("_c = 1").select(key, "term")
    named = relations.where("source is not null").withColumn("slug", text.slug_segment(F.col("source"))).join(first, [key, "slug"])
    bare = relations.where("source is null").join(only, key)
    return named.select(key, "term", "rel", "to").unionByName(bare.select(key, "term", "rel", "to"))


def resolve_endpoints(found: DataFrame, nodes: DataFrame, key: str, *carry: str) -> DataFrame:
    """(key, from_id, rel, to_id, carry...): edges between nodes, by slug; an endpoint that no node has drops its edge.

    ``found`` has (key, source, rel, to), ``nodes`` (key, id, term); of nodes with one slug the smallest id counts.
    """
    ids = nodes.groupBy(key, text.slug_segment(F.col("term")).alias("slug")).agg(F.min("id").alias("id"))
    a, b = ids.select(key, F.col("slug").alias("_a"), F.col("id").alias("from_id")), ids.select(key, F.col("slug").alias("_b"), F.col("id").alias("to_id"))
    rows = found.withColumn("_a", text.slug_segment(F.col("source"))).withColumn("_b", text.slug_segment(F.col("to")))
    return rows.join(a, [key, "_a"]).join(b, [key, "_b"]).select(key, "from_id", "rel", "to_id", *carry)


#: Kinds of blocks that a quote can be placed in.
PLACES = ("Paragraph", "CodeBlock", "BlockQuote", "ListItem", "Table")


def located_graph(notes: DataFrame, quotes: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): quotes with the span of the block they are placed in, and the edges between them with theirs.

    ``notes`` has (key, content, nodes), ``quotes`` (key, id, term, quote), ``found`` (key, source, rel, to, quote).  A
    quote is placed in a block of its own note, so it may be worded anew; one that can't be placed keeps its node or
    edge with an error instead of a span.  Edges one of whose ends names no node are dropped, whatever their quote.
    """
    node = notes.select(key, "content", F.explode(F.filter("nodes", lambda x: x["type"].isin(*PLACES))).alias("x"))
    blocks = node.select(key, F.col("x.seq").alias("n"), text.byte_slice(F.col("content"), F.col("x.span.start"), F.col("x.span.end")).alias("block"))
    spans = node.select(key, F.col("x.seq").alias("n"), "x.span")

    def placed(rows: DataFrame, name: str) -> DataFrame:
        snapped = distill.snap(rows.select(key, F.col(name).alias("quote_id"), "quote"), blocks, (key,))
        return snapped.join(spans, [key, "n"], "left").withColumnRenamed("quote_id", name)

    nodes = quotes.select(key, "id", "term").join(placed(quotes, "id").select(key, "id", "span", "how", "error"), [key, "id"])
    kept = resolve_endpoints(found, quotes, key, "quote").withColumn("edge", F.xxhash64("from_id", "rel", "to_id", "quote"))
    edges = kept.drop("quote").join(placed(kept.dropDuplicates([key, "edge"]), "edge").select(key, "edge", "span", "error"), [key, "edge"]).drop("edge")
    return nodes, edges


def neighbours(notes: DataFrame, candidates: DataFrame, path: str, k: int = 3, stem: bool = False) -> DataFrame:
    """(candidate, rank, rel, score): for each candidate's text its ``k`` best notes, superseded ones left out.

    Name, description and body of the live notes are one field.  A batch of few candidates is scored as the notes are
    read; for a large one they are indexed at ``path``.
    """
    from notewell.operators import index

    live = notes.where("tier <> 'superseded'")
    near = index.nearest(live, candidates, path, ("name", "description", "body"), k, stem)
    return near if near is not None else index.neighbours(index.build(live, path, {"text": ("name", "description", "body")}, stem, carry=()), candidates, k)


def same_items(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same items, each as often."""
    return F.sort_array(a) == F.sort_array(b)


def span_text(span: Column) -> Column:
    return F.concat(span["start"].cast("string"), F.lit(".."), span["end"].cast("string"))


def parse_span(column: Column) -> Column:
    """The span of ``a..b`` or ``[a..b]``; null for anything else."""
    bare = F.regexp_replace(F.trim(column), r"^\[(\d+\.\.\d+)\]$", "$1")
    part = lambda i: F.regexp_extract(bare, r"^(\d+)\.\.(\d+)$", i).cast("long")
    return F.when(bare.rlike(r"^\d+\.\.\d+$"), F.struct(part(1).alias("start"), part(2).alias("end")))


def split_span(column: Column) -> Column:
    """(text, span): a line without the span that ends it, and that span, null if there is none."""
    tail = F.regexp_extract(column, r"\s(\[\d+\.\.\d+\]|\d+\.\.\d+)\s*$", 1)
    return F.struct(F.trim(F.when(tail != "", F.regexp_replace(column, r"\s+(\[\d+\.\.\d+\]|\d+\.\.\d+)\s*$", "")).otherwise(column)).alias("text"), F.when(tail != "", parse_span(tail)).alias("span"))


def check_spelling(before: Column, after: Column) -> Column:
    """Why ``after`` is more than ``before`` with its spelling mended; null if it isn't.

    Masks and lines stay, at most 15 % of the characters (4 at least) change, and each new word is within two edits
    of an old one.  The distance is bounded, so a long block costs its length times the bound.
    """
    masks = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit(r"⟦\d+⟧"), F.lit(0)))
    n_lines = lambda c: F.size(F.split(c, "\n", -1))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    bound = F.greatest(F.lit(4), F.ceil(F.length(before) * 0.15).cast("int")).cast("int")
    near = F.forall(F.array_except(words(after), words(before)), lambda w: F.exists(words(before), lambda o: (F.abs(F.length(o) - F.length(w)) <= 2) & (F.levenshtein(o, w) <= 2)))
    far = F.call_function("levenshtein", before, after, bound) < 0
    return F.when(masks(before) != masks(after), "masks").when(n_lines(before) != n_lines(after), "lines").when(far, "distance").when(~near, "words")


def gate(pairs: DataFrame, key: str) -> DataFrame:
    """(key, spans, headings, fences, breaks, ok): whether a rewrite keeps the spans, and how many of the rest, of its original.

    ``pairs`` has (key, before, after).  Spans are what must survive: code, links, math and addresses.
    """
    kept = lambda c: distill.masked(c)["kept"]
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    same = lambda pattern: count(F.col("before"), pattern) == count(F.col("after"), pattern)
    rows = pairs.select(key, same_items(kept("before"), kept("after")).alias("spans"), same(r"(?m)^ {0,3}#{1,6}\s").alias("headings"), same(r"(?m)^ {0,3}(```|~~~)").alias("fences"), same(r"(?m)^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$").alias("breaks"))
    return rows.withColumn("ok", F.col("spans") & F.col("headings") & F.col("fences") & F.col("breaks"))


def headword(path: Column) -> Column:
    """The title that a path gives: its last name without extension, signs as blanks, the first letter large."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"\.[^.]+$", ""), "[-_]+", " "))
    return F.when(words == "", path).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))))


def handle(label: Column) -> Column:
    """A label as one line of at most 80 characters, without the signs that end code."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(label, "`", ""), r"\s+", " "))
    return F.when(plain == "", "(no label)").when(F.length(plain) > 80, F.concat(F.rtrim(F.substring(plain, 1, 80)), F.lit("…"))).otherwise(plain)


def split_front(content: Column) -> Column:
    """(front, body): the frontmatter with its fences, and what follows less one empty line; ``...`` closes too."""
    plain = F.regexp_replace(content, "^﻿", "")
    front = F.regexp_extract(plain, r"(?s)\A(\s*---\s*?\n(?:.*?\n)??(?:---|\.\.\.)[ \t\r]*(?:\n|\z))", 1)
    return F.struct(front.alias("front"), F.regexp_replace(F.substr(plain, F.length(front) + 1), r"\A\n", "").alias("body"))


def with_trust(content: Column) -> Column:
    """A rewritten note: provisional unless its author says otherwise."""
    front = split_front(content)["front"]
    line = "epistemic_status: provisional\n"
    put = F.regexp_replace(front, r"(?m)^((?:---|\.\.\.)[ \t\r]*\n?)\z", line + "$1")
    plain = F.regexp_replace(content, "^﻿", "")
    return F.when(front == "", F.concat(F.lit(f"---\n{line}---\n"), plain)).when(front.rlike(r"(?m)^epistemic_status:"), plain).otherwise(F.concat(put, F.substr(plain, F.length(front) + 1)))


def name_counts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(name, n, inside): capitalised words, how often they stand, and how often not at the start of a sentence."""
    rows = docs.select(key, F.explode(text.sentences(F.col(column))).alias("s")).select(F.posexplode(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}'’-]+"), F.lit(0))).alias("i", "w"))
    return rows.where(F.col("w").rlike(r"^\p{Lu}\p{Ll}")).groupBy(F.col("w").alias("name")).agg(F.count("*").alias("n"), F.sum((F.col("i") > 0).cast("int")).alias("inside"))


def name_runs(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, sentence, first, run): two or more capitalised words side by side within a sentence, as one name."""
    rows = docs.select(key, F.posexplode(text.sentences(F.col(column))).alias("sentence", "s")).select(key, "sentence", F.posexplode(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}'’-]+"), F.lit(0))).alias("i", "w"))
    names = rows.where(F.col("w").rlike(r"^\p{Lu}\p{Ll}"))
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "sentence").orderBy("i"))
    runs = names.withColumn("_island", island).groupBy(key, "sentence", "_island").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"))
    return runs.where("n > 1").select(key, "sentence", "first", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("run"))


def _fences() -> str:
    """A pattern for fenced blocks: a fence, and all up to one of the same sign or the end."""
    one = lambda sign: rf"^ {{0,3}}{sign}{{3,}}[^\n]*(?:\n.*?)??(?:\n {{0,3}}{sign}{{3,}}[^\n]*$|\z)"
    return f"(?ms){one('`')}|{one('~')}"


def guard(pairs: DataFrame, key: str, cap: int = 20) -> DataFrame:
    """(key, masks, code, names, words, lists, ok): five ways in which a simpler wording must not differ from its original.

    ``pairs`` has (key, before, after).  The same masks and fenced blocks, each as often; no name that the original
    hasn't; no sentence of more than ``cap`` words; no kind of list, bullets or numbers, of which nothing is left.  Lists
    may grow or shrink, and code within a line is a matter of masks.
    """
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    both = lambda pattern: same_items(found("before", pattern), found("after", pattern))
    # A capital within a sentence tells a name; the original may have it anywhere.
    inner = F.regexp_extract_all("after", F.lit(r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}[\p{L}'’-]*"), F.lit(0))
    known = found("before", r"\p{Lu}\p{Ll}[\p{L}'’-]*")
    long = F.exists(text.sentences(F.col("after")), lambda s: text.word_count(s) > cap)
    # A rule of three stars or hyphens looks like a bullet and is none.
    lines = lambda c: F.filter(F.split(F.regexp_replace(c, _fences(), ""), "\n"), lambda x: ~x.rlike(r"^\s*([-*_])(\s*\1){2,}\s*$"))
    any_of = lambda c, pattern: F.exists(lines(c), lambda x: x.rlike(pattern))
    vanished = lambda pattern: any_of("before", pattern) & ~any_of("after", pattern)
    lists = ~vanished(r"^\s*[-*+]\s") & ~vanished(r"^\s*\d{1,9}[.)]\s")
    rows = pairs.select(key, both(r"⟦\d+⟧").alias("masks"), both(_fences()).alias("code"), (F.size(F.array_except(inner, known)) == 0).alias("names"), (~long).alias("words"), lists.alias("lists"))
    return rows.withColumn("ok", F.col("masks") & F.col("code") & F.col("names") & F.col("words") & F.col("lists"))


def assemble(parts: DataFrame, drafts: DataFrame) -> DataFrame:
    """(rel, text): a note put together again: kept units as they were, the others by their drafts, in order.

    ``parts`` are ``units``, ``drafts`` has (rel, unit, draft).  A unit without a draft stays as it was, so that nothing
    is lost by silence; the title comes first.
    """
    rows = parts.join(drafts, ["rel", "unit"], "left")
    piece = F.when(F.col("preserve") | F.col("draft").isNull(), F.col("text")).otherwise(F.col("draft"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("unit", piece.alias("piece")))), lambda x: x["piece"])
    out = rows.groupBy("rel").agg(F.max("title").alias("title"), ordered.alias("pieces"))
    return out.select("rel", F.array_join(F.when(F.col("title") == "", F.col("pieces")).otherwise(F.concat(F.array("title"), F.col("pieces"))), "\n").alias("text"))


def backstop(notes: DataFrame, assembled: DataFrame) -> DataFrame:
    """(rel, lane, markup, item): what whole notes carry that the notes put together of their parts don't.

    The last look before a note is replaced: each unit may have been checked, and something between them be lost.
    ``assembled`` has (rel, text); a note that isn't there has lost all it carried.
    """
    before, after = distill.harvest(notes, "rel", "body"), distill.harvest(assembled, "rel", "text")
    return distill.residue(before, after.select("rel", "lane", "item").distinct(), ["rel", "lane", "item"]).select("rel", "lane", "markup", "item")


def residue_blocks(left: DataFrame, key: str) -> DataFrame:
    """(key, text): what is left of each note as one block of choices, an item an entry in its order, none ticked.

    ``left`` has (key, ord, kind, label, reason, steps), where steps are the places of a procedure's lost steps, from 0.
    An entry that no gate could judge offers to keep it, any other to recover it.  A definition is named by its term in
    code, a step by its procedure and place, and anything else by its label.
    """
    plain = handle(F.col("label"))
    places = F.array_join(F.transform("steps", lambda i: (i + 1).cast("string")), ",")
    steps = F.concat(F.lit("procedure:"), plain, F.when(F.size("steps") > 0, F.concat(F.lit(":"), places)).otherwise(""))
    target = F.when(F.col("kind") == "def", F.concat(F.lit("`"), plain, F.lit("`"))).when(F.col("kind") == "steps", steps).when(F.col("kind") == "thesis", "thesis").otherwise(plain)
    verb = F.when(F.col("reason") == "gate-inconclusive", "keep").otherwise("recover")
    rows = left.select(key, "ord", F.concat(F.lit("- [ ] "), verb, F.lit(" "), target, F.lit(" — "), "reason").alias("item"))
    listed = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), "\n").alias("items"))
    return listed.select(key, F.concat(F.lit("<!-- interact: pick-any id=residue -->\n\n"), "items", F.lit("\n\n<!-- /interact -->\n")).alias("text"))


def staged(found: DataFrame, verdicts: DataFrame, key: str, registry: list[str]) -> DataFrame:
    """(key, term, rel, to, off_registry, verdict, inconclusive): edges of concepts as they wait for a decision.

    ``found`` is what ``attach`` gives, ``verdicts`` has (key, term, verdict).  A relation that isn't registered is
    marked; an edge is inconclusive exactly if its concept has no verdict.
    """
    rows = found.join(verdicts, [key, "term"], "left")
    return rows.select(key, "term", "rel", "to", (~F.col("rel").isin(registry)).alias("off_registry"), "verdict", F.col("verdict").isNull().alias("inconclusive"))

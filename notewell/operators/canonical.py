"""Whole canonical notes: a graph of units and edges written as markdown, and read back from it.

A note has a title, an abstract, a section for each kind of unit and one for the relations.  A graph is three tables:

* notes: (key, path, bytes, sha256, title, abstract);
* units: (key, ord, id, type, statement, span, modality, sub_spans), where a concept's statement is a definition and its
  bullets, a procedure's its steps, a line each, and ``sub_spans`` has the places of all lines but the first;
* edges: (key, ord, from_id, rel, to_id, span).

What a note holds is gathered and spread by its key; one note's units are one row's array, as its text is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import notes as N
from notewell.operators import review as V
from notewell.sources.shared import dealt, written

#: The headings of the sections, in their order, and the modalities that are marked.
SECTIONS = {"concept": "Concepts", "judgment": "Judgements", "inference": "Inferences", "procedure": "Procedures", "payload": "Payload"}
ABSTRACT, RELATIONS = "Abstract", "Relations"
MARKED = ("hypothesis", "necessarily")
DASH, ARROW = " — ", " → "
SCHEMA = "1"
SPAN = "struct<start:bigint,`end`:bigint>"


def _lines(statement: Column) -> Column:
    return F.filter(F.transform(F.split(statement, "\n"), F.trim), lambda x: x != "")


def _anchor(span: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" "), V.span_text(span)), F.lit(""))


def _tail(i: Column) -> Column:
    return _anchor(F.get("sub_spans", i))


def rendered(units: DataFrame) -> DataFrame:
    """``units`` with the markdown of each in ``shown``."""
    lines, head = _lines(F.col("statement")), F.concat(F.lit("### "), "id", F.lit("\n\n"))
    bullets = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.concat(F.lit("- "), x, _tail(i))), "\n")
    concept = F.concat(head, F.get(lines, F.lit(0)), _anchor(F.col("span")), F.when(F.size(lines) > 1, F.concat(F.lit("\n\n"), bullets)).otherwise(""))
    steps = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.when(i == 0, _anchor(F.col("span"))).otherwise(_tail(i - 1))))
    procedure = F.concat(head, F.array_join(steps, "\n"))
    # A fence longer than any run of its sign in the text.
    runs = F.transform(F.regexp_extract_all("statement", F.lit("`+"), F.lit(0)), F.length)
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    fenced = F.concat(head, fence, F.lit("\n"), "statement", F.lit("\n"), fence, F.lit("\n\n"), V.span_text(F.col("span")))
    payload = F.when(F.col("statement").contains("\n"), fenced).otherwise(F.concat(head, F.lit("> "), "statement", _anchor(F.col("span"))))
    tag = F.when(F.col("modality").isin(*MARKED), F.concat(F.lit("("), "modality", F.lit(") "))).otherwise("")
    flat = F.concat(F.lit("- "), F.when(F.col("type") == "judgment", tag).otherwise(""), "statement", _anchor(F.col("span")))
    shown = F.when(F.col("type") == "concept", concept).when(F.col("type") == "procedure", procedure).when(F.col("type") == "payload", payload).otherwise(flat)
    return units.withColumn("shown", shown)


def _lower(term: Column) -> Column:
    return F.concat(F.lower(F.substring(term, 1, 1)), F.substr(term, F.lit(2)))


def _judged(units: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Edges with the ``error`` that keeps them from being written, or null."""
    ids = units.select(key, F.col("id").alias("_id")).distinct().withColumn("_is", F.lit(True))
    a, b = (ids.withColumnRenamed("_id", c).withColumnRenamed("_is", f"_{c}") for c in ("from_id", "to_id"))
    rows = edges.join(a, [key, "from_id"], "left").join(b, [key, "to_id"], "left")
    error = F.when(F.trim(F.coalesce("rel", F.lit(""))) == "", "no relation").when(F.col("_from_id").isNull(), "from names no unit").when(F.col("_to_id").isNull(), "to names no unit")
    return rows.select(*(edges[c] if c not in (key, "from_id", "to_id") else c for c in edges.columns), error.alias("error"))


def problems(units: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, ord, error): edges that can't be written: without a relation, or with an end that names no unit."""
    return _judged(units, edges, key).select(key, "ord", "error").where("error is not null")


def write(notes: DataFrame, units: DataFrame, edges: DataFrame, key: str, relations: bool = True) -> DataFrame:
    """(key, text): each note as markdown; sections without units are left out, and edges that have a problem.

    A note without a title is named by its path.  Statements of judgements and inferences are one line.
    """
    joined = lambda rows, sep: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["shown"]), sep)
    kind = {name: i for i, name in enumerate(SECTIONS)}
    rank = reduce(lambda other, name: F.when(F.col("type") == name, kind[name]).otherwise(other), kind, F.lit(None).cast("int"))
    title = reduce(lambda other, name: F.when(F.col("type") == name, SECTIONS[name]).otherwise(other), SECTIONS, F.lit(None).cast("string"))
    whole = rendered(units).where(rank.isNotNull()).groupBy(key, "type").agg(joined(F.struct("ord", "shown"), "\n\n").alias("wide"), joined(F.struct("ord", "shown"), "\n").alias("tight"))
    shown = F.concat(F.lit("## "), title, F.lit("\n\n"), F.when(F.col("type").isin("judgment", "inference"), F.col("tight")).otherwise(F.col("wide")))
    sections = whole.select(key, rank.alias("rank"), shown.alias("shown"))
    if relations:
        sound = _judged(units, edges, key).where("error is null")
        line = F.concat(F.lit("- "), _lower(F.col("from_id")), F.lit(DASH), "rel", F.lit(ARROW), _lower(F.col("to_id")), _anchor(F.col("span")))
        said = sound.select(key, F.struct("ord", line.alias("shown")).alias("x")).groupBy(key).agg(F.concat(F.lit(f"## {RELATIONS}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["shown"]), "\n")).alias("shown"))
        sections = sections.unionByName(said.select(key, F.lit(len(SECTIONS)).alias("rank"), "shown"))
    bodies = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), "\n\n").alias("body"))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]+$", ""), "[-_]+", " "))
    named = F.coalesce("title", F.when(words != "", F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))).otherwise(F.col("path")))
    front = F.concat(F.lit("---\ntype: distillation\nsource: { path: "), "path", F.lit(", bytes: "), F.col("bytes").cast("string"), F.lit(", sha256: "), "sha256", F.lit(f" }}\nschema: {SCHEMA}\n---\n\n# "), named)
    about = F.when(F.trim(F.coalesce("abstract", F.lit(""))) != "", F.concat(F.lit(f"\n\n## {ABSTRACT}\n\n"), F.trim("abstract"))).otherwise("")
    rest = F.coalesce(F.concat(F.lit("\n\n"), "body"), F.lit(""))
    return notes.join(bodies, key, "left").select(key, F.concat(front, about, rest, F.lit("\n")).alias("text"))


def read(docs: DataFrame, key: str, column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, units, edges) of canonical notes (key, text).

    Sections and subsections are the headings of levels 2 and 3 that the structure has, so nothing in a fence opens
    one.  A concept without a definition and a procedure without a step are left out, as is what stands in no known
    section.  A line without an anchor has a null span.  Judgements and inferences are numbered in their
    order; the ends of an edge name the units with their slugs, and an end that names none has a null id.
    """
    parsed = N.parse(dealt(docs.select(F.col(key).alias("rel"), F.col(column).alias("content")), "rel"), "headings", "nodes")
    # All three tables come from one parse, and all sections from one look at the lines.
    parsed = written(parsed.select("rel", "content", "headings", "nodes"), "canonical-notes")
    code = F.filter("nodes", lambda n: (n["type"] == "CodeBlock") & (n["depth"] == 0))
    heads = F.transform(F.filter("headings", lambda h: h["level"].isin(2, 3)), lambda h: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["text"].alias("text")))
    rows = parsed.select("rel", heads.alias("heads"), code.alias("code"), text.lines(F.col("content")).alias("lines"))

    def stretch(h: Column, i: Column) -> Column:
        """The lines from a heading to the next one, with the section and the subsection that they stand in."""
        section = F.when(h["level"] == 2, h).otherwise(F.try_element_at(F.filter(F.slice("heads", 1, i), lambda x: x["level"] == 2), F.lit(-1)))
        until = F.coalesce(F.get("heads", i + 1)["line"], F.size("lines") + 1)
        own = F.slice("lines", h["line"] + 1, F.greatest(F.lit(0), until - h["line"] - 1))
        return F.struct(F.lower(F.trim(section["text"])).alias("section"), F.when((h["level"] == 3) & section.isNotNull(), h).alias("sub"), (h["line"] + 1).alias("first"), own.alias("own"))

    rows = rows.select("rel", "code", F.inline(F.transform("heads", stretch)))
    rows = rows.select("rel", "code", "section", "sub", "first", F.posexplode("own").alias("i", "line")).withColumn("at", F.col("first") + F.col("i"))
    rows = rows.select("rel", "at", "line", F.exists("code", lambda c: (c["start_line"] <= F.col("at")) & (F.col("at") <= c["end_line"])).alias("coded"), "section", "sub")
    rows = written(rows, "canonical-lines")
    plain = rows.where("not coded").withColumn("t", F.trim("line"))
    gathered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))), lambda x: x["v"])
    cut = V.split_span
    item = F.expr("substr(t, 3)")

    def within(kind: str) -> DataFrame:
        return plain.where((F.col("section") == SECTIONS[kind].lower()) & F.col("sub").isNotNull() & (F.col("t") != ""))

    def statement(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")

    def unit(rows: DataFrame, kind: str, name: Column, parts: Column, order: Column, mark: Column | None = None) -> DataFrame:
        return rows.select("rel", F.lit(list(SECTIONS).index(kind)).alias("rank"), order.alias("at"), name.alias("id"), F.lit(kind).alias("type"), statement(parts).alias("statement"), F.get(parts, F.lit(0))["span"].alias("span"), (F.lit(None).cast("string") if mark is None else mark).alias("modality"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x["span"]).alias("sub_spans"))

    bullet = F.startswith("t", F.lit("- "))
    concepts = within("concept").groupBy("rel", "sub").agg(gathered(F.when(~bullet, cut(F.col("t")))).alias("defs"), gathered(F.when(bullet, cut(item))).alias("bullets"))
    concepts = concepts.withColumn("parts", F.concat(F.slice(F.array_compact("defs"), 1, 1), F.array_compact("bullets"))).where(F.get(F.array_compact("defs"), F.lit(0))["text"] != "")
    numbered = F.regexp_extract("line", r"^\s*\d+\.\s(.*)$", 1)
    procedures = within("procedure").where(F.col("line").rlike(r"^\s*\d+\.\s")).groupBy("rel", "sub").agg(gathered(cut(numbered)).alias("parts"))
    quoted = within("payload").groupBy("rel", "sub").agg(gathered(F.when(F.startswith("t", F.lit(">")), cut(F.regexp_replace("t", r"^>\s?", "")))).alias("quotes"), gathered(F.when(F.col("t").rlike(r"^(\[\d+\.\.\d+\]|\d+\.\.\d+)$"), V.parse_span(F.col("t"))).otherwise(cut(F.col("t"))["span"])).alias("anchors"))
    blocks = parsed.select("rel", "content", F.explode(code).alias("c")).select("rel", F.col("c.start_line").alias("at"), text.byte_slice(F.col("content"), F.col("c.body_span.start"), F.col("c.body_span.end")).alias("body"))
    bodies = rows.where("coded and sub is not null").join(blocks, ["rel", "at"]).groupBy("rel", "sub").agg(F.min_by("body", "at").alias("body"))
    payloads = quoted.join(bodies, ["rel", "sub"], "full")
    quote = F.get(F.array_compact("quotes"), F.lit(0))
    one = F.when(quote.isNotNull(), quote).otherwise(F.struct(F.coalesce("body", F.lit("")).alias("text"), F.get(F.array_compact("anchors"), F.lit(0)).alias("span")))
    payloads = payloads.withColumn("parts", F.array(one))
    named, order = F.col("sub.text"), F.col("sub.line")
    units = [unit(rows_, kind, named, F.col("parts"), order) for kind, rows_ in (("concept", concepts), ("procedure", procedures), ("payload", payloads))]
    for kind, letter in (("judgment", "J"), ("inference", "I")):
        flat = plain.where((F.col("section") == SECTIONS[kind].lower()) & bullet)
        tag = F.regexp_extract(item, r"^\((" + "|".join(MARKED) + r")\)\s+", 1)
        flat = flat.withColumn("parts", F.array(cut(F.regexp_replace(item, r"^\((?:" + "|".join(MARKED) + r")\)\s+", "")))).withColumn("tag", F.nullif(tag, F.lit("")))
        number = F.row_number().over(Window.partitionBy("rel").orderBy("at"))
        units.append(unit(flat.withColumn("id", F.concat(F.lit(letter), number.cast("string"))), kind, F.col("id"), F.col("parts"), F.col("at"), None if kind == "inference" else F.col("tag")))
    every = reduce(DataFrame.unionByName, units)
    every = every.withColumn("ord", F.row_number().over(Window.partitionBy("rel").orderBy("rank", "at")) - 1)
    every = written(every, "canonical-units")
    said = plain.where((F.col("section") == RELATIONS.lower()) & bullet).withColumn("x", cut(item))
    ends = said.select("rel", "at", F.substring_index("x.text", DASH, 1).alias("source"), F.expr(f"substr(x.text, instr(x.text, '{DASH}') + {len(DASH)})").alias("right"), "x.span")
    ends = ends.select("rel", "at", "source", F.substring_index("right", ARROW, 1).alias("edge"), F.expr(f"substr(right, instr(right, '{ARROW}') + {len(ARROW)})").alias("target"), "span")
    slugs = every.groupBy("rel", text.slug_segment(F.col("id")).alias("_s")).agg(F.min_by("id", "ord").alias("_id"))
    for side, name in (("source", "from_id"), ("target", "to_id")):
        ends = ends.withColumn("_s", text.slug_segment(F.col(side))).join(slugs.withColumnRenamed("_id", name), ["rel", "_s"], "left").drop("_s")
    edges = ends.select("rel", (F.row_number().over(Window.partitionBy("rel").orderBy("at")) - 1).alias("ord"), "from_id", F.col("edge").alias("rel_"), "to_id", "span")
    abstract = plain.where(F.col("section") == ABSTRACT.lower()).groupBy("rel").agg(F.regexp_replace(F.array_join(gathered(F.col("line")), "\n"), r"^\s+|\s+$", "").alias("abstract"))
    title = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    # A digest may look like a number, so the line is read as it stands and not as YAML.
    line = r"(?m)^source: \{ path: (.*), bytes: (\d+), sha256: (\S+) \}\s*$"
    source = lambda i: F.nullif(F.regexp_extract("content", line, i), F.lit(""))
    head = parsed.select("rel", source(1).alias("path"), source(2).cast("long").alias("bytes"), source(3).alias("sha256"), title.alias("title")).join(abstract, "rel", "left")
    back = lambda df: df.withColumnRenamed("rel", key)
    return back(head), back(every.select("rel", "ord", "id", "type", "statement", "span", "modality", "sub_spans")), back(edges).withColumnRenamed("rel_", "rel")

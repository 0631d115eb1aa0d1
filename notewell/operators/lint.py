"""Lint rules: each is a function from the shared tables of a vault to findings."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions import text
from notewell.operators import notes as N
from notewell.sources.shared import written

#: Fields that each type must have.
REQUIRED = {
    "card": ["description", "tags", "reference"],
    "note": ["description", "tags"],
    "reference": ["description", "tags"],
    "project": ["result", "status", "goal"],
    "track": ["slug", "description", "status", "project", "created", "updated"],
    "ticket": ["slug", "description", "status", "project", "kind", "created", "updated"],
    "scratchpad": ["project", "created", "updated"],
    "experiment": ["description", "verdict", "date"],
    "checkpoint": [],
    "weekly-log": ["week", "start", "end", "sleep"],
    "goal": ["description", "tags"],
}
#: Fields that every type may have.
UNIVERSAL = ["type", "template", "created", "updated", "related", "superseded", "superseded_by", "supersedes", "aliases"]
#: The registered relations.
RELATIONS = ["subsumes", "precondition-for", "contrast-to", "depends-on", "part-of", "instance-of", "refines"]
#: Types of which a project has one, and its name.
SINGLETONS = {"context": "Context", "scratchpad": "Scratchpad"}
SIZED = ["card", "note", "experiment", "ticket"]
CAP = 4000


@dataclass
class Vault:
    """The tables that rules share.  Each is derived once; Spark reuses the exchange of equal branches."""

    notes: DataFrame
    assets: DataFrame | None = None
    cap: int = CAP

    @cached_property
    def curated(self) -> DataFrame:
        return self.notes.where(~F.col("lint_exempt"))

    @cached_property
    def links(self) -> DataFrame:
        return N.links(self.notes)

    def body_links_of(self, kind: str) -> DataFrame:
        """Body links of the curated notes of a type, from the notes' own rows."""
        return N.links(self.curated.where(F.col("type") == kind)).where("surface = 'body'")

    @cached_property
    def note_keys(self) -> DataFrame:
        return N.with_key(self.notes).select(F.col("note_key").alias("link_key")).distinct()

    @cached_property
    def target_keys(self) -> DataFrame:
        if self.assets is None:
            return self.note_keys
        return self.note_keys.union(self.assets.select(text.normalized(F.col("rel")).alias("link_key"))).union(self.assets.select(text.normalized(F.element_at(F.split("rel", "/"), -1)).alias("link_key"))).distinct()


def parsed_once(files: DataFrame, *parts: str) -> DataFrame:
    """Parsed notes as a table in the shared folder: rules look at them from several sides, and nothing stays in memory."""
    return written(N.parse(files, *parts), "linted-notes")


def _found(rows: DataFrame, message) -> DataFrame:
    return rows.select(F.col("rel").alias("file"), message.alias("message"))


def _first_per(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("line").asc_nulls_last(), "ord", "target")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def broken_wikilink(v: Vault) -> DataFrame:
    links = N.links(v.curated)
    # A target of an asset may name its folder; its key is then the whole path.
    missing = links.join(v.target_keys, "link_key", "left_anti")
    if v.assets is not None:
        whole = v.assets.select(text.normalized(F.col("rel")).alias("_whole"))
        missing = missing.withColumn("_whole", text.normalized(F.substring_index("target", "#", 1))).join(whole, "_whole", "left_anti").drop("_whole")
    return _found(_first_per(missing, "rel", "target"), F.concat(F.lit("broken wikilink [["), "target", F.lit("]]")))


def dangling_reference(v: Vault) -> DataFrame:
    """Reference notes that no card refers to."""
    said = v.notes.where("type = 'card'").select(F.explode(F.col("fm")["reference"]["links"]).alias("l")).select(text.link_key(F.col("l.target")).alias("note_key"))
    return _found(N.with_key(v.notes.where("type = 'reference' and not is_template")).join(said, "note_key", "left_anti"), F.concat(F.lit("reference '"), "name", F.lit("' is not used by any card")))


def dangling_requires_target(v: Vault) -> DataFrame:
    tickets = N.with_key(v.notes.where("type = 'ticket'")).select(F.col("note_key").alias("link_key"))
    asks = v.curated.where("type = 'ticket'").select("rel", F.explode(F.col("fm")["requires"]["links"]).alias("l")).select("rel", "l.target", text.link_key(F.col("l.target")).alias("link_key")).dropDuplicates(["rel", "link_key"])
    return _found(asks.join(tickets, "link_key", "left_anti"), F.concat(F.lit("requires [["), "target", F.lit("]], which is no ticket")))


def orphan_card(v: Vault) -> DataFrame:
    index = F.startswith("name", F.lit("~")) & (F.concat(F.lit("~"), F.element_at(F.split("folder", "/"), -1)) == F.col("name"))
    cards = N.with_key(v.curated.where((F.col("type") == "card") & ~index))
    return _found(cards.join(v.links.select(F.col("link_key").alias("note_key")), "note_key", "left_anti"), F.concat(F.lit("card '"), "name", F.lit("' has no inbound wikilinks")))


def reference_vault_link(v: Vault) -> DataFrame:
    links = v.body_links_of("reference").join(v.note_keys, "link_key", "left_semi")
    return _found(_first_per(links, "rel", "link_key"), F.concat(F.lit("reference links to vault entry [["), "target", F.lit("]]")))


def reference_wrong_type(v: Vault) -> DataFrame:
    """Cards whose reference is a note of another type; of notes with one name the last by path counts."""
    types = N.with_key(v.notes).groupBy("note_key").agg(F.max_by("type", "rel").alias("_type"))
    said = v.curated.where("type = 'card'").select("rel", F.explode(F.col("fm")["reference"]["links"]).alias("l")).select("rel", "l.target", text.link_key(F.col("l.target")).alias("note_key"))
    return _found(said.join(types, "note_key").where("_type <> 'reference'"), F.concat(F.lit("reference [["), "target", F.lit("]] has type '"), "_type", F.lit("'")))


def reference_not_wikilink(v: Vault) -> DataFrame:
    strings = v.curated.where("type = 'card'").select("rel", F.explode(F.col("fm")["reference"]["strings"]).alias("s"))
    return _found(strings.where(~F.col("s").rlike(r"\[\[[^\[\]\n|]+(\|[^\[\]\n]*)?\]\]")), F.concat(F.lit("reference is no wikilink: "), F.substring("s", 1, 80)))


def ticket_outward_only(v: Vault) -> DataFrame:
    links = v.body_links_of("ticket")
    return _found(_first_per(links, "rel", "link_key"), F.concat(F.lit("ticket links outward to [["), "target", F.lit("]]")))


def template_schema(v: Vault) -> DataFrame:
    """(type, allowed, enums): what the templates of each type allow, with the universal fields."""
    templates = v.notes.where("is_template and type <> ''").select("type", F.explode("fm").alias("key", "v"))
    allowed = templates.groupBy("type").agg(F.array_sort(F.array_union(F.collect_set("key"), F.array(*map(F.lit, UNIVERSAL)))).alias("allowed"))
    return allowed


def template_enums(v: Vault) -> DataFrame:
    """(type, key, options): the pickers of each type's templates, lists of scalars that aren't empty."""
    entries = v.notes.where("is_template and type <> ''").select("type", F.explode("fm").alias("key", "v")).where(F.size("v.items") > 0).where("v.kind = 'list'")
    return entries.groupBy("type", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v.items")))).alias("options"))


def unknown_field(v: Vault) -> DataFrame:
    fields = v.curated.select("rel", "type", F.explode(F.map_keys("fm")).alias("key"))
    # A row a type; dealt by type, all fields of the commonest one would be one task's.
    return _found(fields.join(F.broadcast(template_schema(v)), "type").where(~F.array_contains("allowed", F.col("key"))), F.concat(F.lit("unknown field '"), "key", F.lit("' for type '"), "type", F.lit("'")))


def invalid_enum_value(v: Vault) -> DataFrame:
    values = v.curated.select("rel", "type", F.explode("fm").alias("key", "v")).where("v.kind = 'string' and v.display <> ''")
    return _found(values.join(F.broadcast(template_enums(v)), ["type", "key"]).where(~F.array_contains("options", F.col("v.display"))), F.concat(F.lit("'"), "v.display", F.lit("' is no option of '"), "key", F.lit("'")))


def missing_required_field(v: Vault) -> DataFrame:
    """A key that is there counts, even if it is empty."""
    needs = F.lit(None).cast("array<string>")
    for kind, fields in REQUIRED.items():
        needs = F.when(F.col("type") == kind, F.array(*map(F.lit, fields)).cast("array<string>")).otherwise(needs)
    lacks = v.curated.select("rel", "type", F.explode(F.array_except(needs, F.map_keys("fm"))).alias("key"))
    return _found(lacks, F.concat(F.lit("missing required field '"), "key", F.lit("' for type '"), "type", F.lit("'")))


def slug_filename_mismatch(v: Vault) -> DataFrame:
    slug = text.shown(F.col("fm")["slug"]["display"])
    rows = v.curated.where(F.col("type").isin("ticket", "track") & (slug != "") & (F.col("name") != F.concat("type", F.lit("-"), slug)))
    return _found(rows, F.concat(F.lit("file should be named '"), "type", F.lit("-"), slug, F.lit("'")))


def singleton_filename_mismatch(v: Vault) -> DataFrame:
    right = F.lit(None).cast("string")
    for kind, name in SINGLETONS.items():
        right = F.when(F.col("type") == kind, name).otherwise(right)
    return _found(v.curated.where(right.isNotNull() & (F.col("name") != right)), F.concat(F.lit("file should be named '"), right, F.lit("'")))


def singleton_tag(v: Vault) -> DataFrame:
    tags = v.notes.select("rel", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.min("rel").alias("rel")).where("n = 1")
    return _found(tags, F.concat(F.lit("tag '"), "tag", F.lit("' is used once")))


def oversized_entry(v: Vault) -> DataFrame:
    return _found(v.curated.where(F.col("type").isin(SIZED) & (F.col("tokens") > v.cap)), F.concat("type", F.lit(" '"), "name", F.lit("' has about "), F.col("tokens").cast("string"), F.lit(" tokens")))


def untagged_card(v: Vault) -> DataFrame:
    return _found(v.curated.where("type = 'card'").where(F.coalesce(F.col("fm")["tags"]["seq_len"], F.lit(0)) == 0), F.concat(F.lit("card '"), "name", F.lit("' has no tags")))


def untyped_entry(v: Vault) -> DataFrame:
    return _found(v.curated.where("type = ''"), F.concat(F.lit("'"), "name", F.lit("' has no type field")))


def invalid_frontmatter(v: Vault) -> DataFrame:
    return _found(v.notes.where("fm_error is not null"), F.concat(F.lit("invalid frontmatter: "), "fm_error"))


def filename_hygiene(v: Vault) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("name").rlike("[‘’“”]"), "smart-quote"), F.when(F.col("name").contains("  "), "double-space"), F.when(F.endswith("name", F.lit(" ")), "trailing-space")))
    return _found(v.notes.where(F.size(issues) > 0), F.array_join(issues, ", "))


def duplicate_h1(v: Vault) -> DataFrame:
    """The body begins with a level-1 heading, before any other block, that repeats the name."""
    first = F.get("headings", F.lit(0))
    opens = F.col("opens") if "opens" in v.notes.columns else F.forall(F.filter("nodes", lambda n: n["depth"] == 0), lambda n: n["span"]["start"] > first["span"]["start"])
    rows = v.curated.where((first["level"] == 1) & (first["text"] == F.col("name")) & opens)
    return _found(rows, F.concat(F.lit("heading repeats the name '"), "name", F.lit("'")))


def unquoted_frontmatter_link(v: Vault) -> DataFrame:
    rows = v.notes.select("rel", F.explode("unquoted").alias("u")).select("rel", "u.target").distinct()
    return _found(rows, F.concat(F.lit("quote [["), "target", F.lit("]] in frontmatter")))


def callout_missing_separator(v: Vault) -> DataFrame:
    """A callout's head runs on into its text: the first paragraph of a quote, at any depth, goes past its first line."""
    # Nodes are numbered in the order of the text, so a block's first child is the next one.
    leads = F.col("leads") if "leads" in v.notes.columns else F.filter("nodes", lambda n: (n["type"] == "Paragraph") & (n["parent_seq"] == n["seq"] - 1) & (n["end_line"] > n["start_line"]) & (F.get("nodes", n["parent_seq"])["type"] == "BlockQuote"))
    rows = v.curated.where(F.col("content").contains("[!")).select("rel", "content", F.explode(leads).alias("n"))
    head = text.byte_slice(F.col("content"), F.col("n.span.start"), F.col("n.span.end"))
    return _found(rows.where(head.rlike(r"^\s*\[![^\]\r\n]*[^\]\s][^\]\r\n]*\]")), F.concat(F.lit("no separator after the callout in line "), F.col("n.start_line").cast("string")))


def unintended_emphasis(v: Vault) -> DataFrame:
    """Emphasis whose signs look as if they stood for themselves; the widest of nested runs.

    Either both ends are part of a path or pattern (a dot or slash beside them, one that ends no sentence), or the run
    has three signs and more, or doubled low lines hold a bare identifier.
    """
    raw = F.encode("content", "utf-8")
    of = "emphasis" if "emphasis" in v.notes.columns else "inlines"
    runs = F.filter(of, lambda i: i["type"].isin("Emph", "Strong"))
    rows = v.curated.where(F.exists(of, lambda i: i["type"].isin("Emph", "Strong"))).select("rel", raw.alias("raw"), runs.alias("runs"))
    cut = lambda i: F.decode(F.substring("raw", (i["span"]["start"] + 1).cast("int"), (i["span"]["end"] - i["span"]["start"]).cast("int")), "utf-8")
    rows = rows.withColumn("runs", F.transform("runs", lambda i: i.withField("text", cut(i))))

    def literal(i):
        width = F.when(i["type"] == "Strong", 2).otherwise(1)
        inner = F.substr(i["text"], width + 1, F.length(i["text"]) - 2 * width)
        beside = lambda name: F.coalesce(i[name], F.lit(""))
        opens = beside("before").isin(".", "/") | inner.rlike(r"^[./]")
        closes = inner.rlike(r"/$") | (beside("after") == "/") | ((beside("after") == ".") & beside("after_next").rlike(r"^[\p{L}\p{N}]"))
        return (opens & closes) | i["text"].rlike(r"^(\*{3}|_{3})") | (i["text"].rlike(r"^__") & inner.rlike(r"^[A-Za-z0-9_]+$"))

    rows = rows.select("rel", F.filter("runs", literal).alias("runs"))
    inside = lambda i, o: (o["span"]["start"] <= i["span"]["start"]) & (i["span"]["end"] <= o["span"]["end"]) & (o["span"] != i["span"])
    rows = rows.select("rel", F.explode(F.filter("runs", lambda i: ~F.exists("runs", lambda o: inside(i, o)))).alias("i"))
    shown = F.when(F.length("i.text") <= 60, F.col("i.text")).otherwise(F.concat(F.substring("i.text", 1, 60), F.lit("…")))
    return _found(rows, F.concat(F.lit("line "), F.col("i.start_line").cast("string"), F.lit(": emphasis may be unintended: "), shown))


def relations(notes: DataFrame) -> DataFrame:
    """(rel, line, from_label, rel_token, endpoint_kind, endpoint, predicate): edges of the Relations section.

    Sections come from the headings by a forward fill over the lines; an edge is ``from rel:: to (predicate)`` or
    ``from — rel → to (predicate)``, and a place that ends the line belongs to neither side.
    """
    found = F.get(F.filter("headings", lambda h: (h["level"] == 2) & (F.lower(F.trim(h["text"])) == "relations")), F.lit(0))
    rows = notes.select("rel", found.alias("h"), text.lines(F.col("content")).alias("lines")).where("h is not null")
    rows = rows.select("rel", "h", F.posexplode(F.slice("lines", F.col("h.line") + 1, F.greatest(F.lit(0), F.col("h.sec_end") - F.col("h.line")))).alias("i", "text"))
    item = F.trim(F.regexp_extract("text", r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", 1))
    edge = F.trim(F.regexp_replace(item, r"\s+(?:\[\d+\.\.\d+\]|\d+\.\.\d+)$", ""))
    arrow = r"^(.*?)\s*[—–]\s*([^—–→]+?)\s*→\s*(.*)$"
    rows = rows.select("rel", (F.col("h.line") + 1 + F.col("i")).alias("line"), edge.alias("edge"))
    rows = rows.withColumn("arrow", F.col("edge").rlike(arrow) & (F.instr("edge", "::") == 0)).where("arrow or instr(edge, '::') > 0")
    part = lambda i: F.regexp_extract("edge", arrow, i)
    left, right = F.trim(F.substring_index("edge", "::", 1)), F.trim(F.expr("substr(edge, instr(edge, '::') + 2)"))
    words = F.split(left, r"\s+")
    source = F.when(F.col("arrow"), F.trim(part(1))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    token = F.when(F.col("arrow"), F.regexp_replace(F.trim(part(2)), r"\s+", "-")).otherwise(F.element_at(words, -1))
    rows = rows.select("rel", "line", source.alias("source"), token.alias("token"), F.when(F.col("arrow"), F.trim(part(3))).otherwise(right).alias("right")).where("token <> '' and right <> ''")
    has = F.col("right").rlike(r"\([^(]*\)$")
    end = F.when(has, F.trim(F.regexp_replace("right", r"\([^(]*\)$", ""))).otherwise(F.col("right"))
    predicate = F.nullif(F.trim(F.regexp_extract("right", r"\(([^(]*)\)$", 1)), F.lit(""))
    inner = F.trim(F.get(F.split(F.regexp_extract(end, r"^\[\[(.*)\]\]$", 1), r"\|"), F.lit(0)))
    is_file = end.rlike(r"^\[\[.*\]\]$")
    out = rows.select("rel", "line", F.nullif("source", F.lit("")).alias("from_label"), F.col("token").alias("rel_token"), F.when(is_file, "file").otherwise("local").alias("endpoint_kind"), F.when(is_file, inner).otherwise(end).alias("endpoint"), predicate.alias("predicate"))
    return out.where("endpoint <> ''")


def local_nodes(notes: DataFrame) -> DataFrame:
    """(rel, kind, slug): first cells of the Glossary's tables, and the items of the Workflow."""
    rows = notes.select("rel", F.explode(F.filter("headings", lambda h: F.lower(F.trim(h["text"])).isin("glossary", "workflow"))).alias("h"), text.lines(F.col("content")).alias("lines"))
    rows = rows.select("rel", F.lower(F.trim("h.text")).alias("kind"), F.explode(F.slice("lines", F.col("h.line") + 1, F.greatest(F.lit(0), F.col("h.sec_end") - F.col("h.line")))).alias("t"), F.col("h.line").alias("h_line"))
    cell = F.trim(F.get(F.split(F.regexp_replace("t", r"^\s*\|?", ""), r"(?<!\\)\|"), F.lit(0)))
    is_row = F.col("t").rlike(r"^\s*\|") & ~F.col("t").rlike(r"^\s*\|?[\s:|-]+$")
    item = F.regexp_extract("t", r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?(.*)$", 1)
    label = F.when((F.col("kind") == "glossary") & is_row, cell).when((F.col("kind") == "workflow") & (item != ""), item)
    out = rows.select("rel", "kind", text.slug_segment(label).alias("slug")).where("slug <> ''")
    # The head of a glossary's table is no term.
    return out.where("not (kind = 'glossary' and slug = 'term')").distinct()


def dangling_relation_label(v: Vault) -> DataFrame:
    edges = relations(v.curated)
    ends = edges.select("rel", F.explode(F.array_compact(F.array(F.col("from_label"), F.when(F.col("endpoint_kind") == "local", F.col("endpoint"))))).alias("label")).withColumn("slug", text.slug_segment(F.col("label")))
    return _found(ends.join(local_nodes(v.curated), ["rel", "slug"], "left_anti"), F.concat(F.lit("relation label '"), "label", F.lit("' is no local node")))


def unknown_rel(v: Vault) -> DataFrame:
    return _found(relations(v.curated).where(~F.col("rel_token").isin(RELATIONS)), F.concat(F.lit("unknown relation '"), "rel_token", F.lit("'")))


#: Each rule with its default severity.
RULES: dict[str, tuple[str, Callable[[Vault], DataFrame]]] = {
    "broken-wikilink": ("error", broken_wikilink),
    "callout-missing-separator": ("warn", callout_missing_separator),
    "dangling-reference": ("warn", dangling_reference),
    "dangling-relation-label": ("error", dangling_relation_label),
    "dangling-requires-target": ("warn", dangling_requires_target),
    "duplicate-h1": ("warn", duplicate_h1),
    "filename-hygiene": ("warn", filename_hygiene),
    "invalid-enum-value": ("warn", invalid_enum_value),
    "invalid-frontmatter": ("error", invalid_frontmatter),
    "missing-required-field": ("warn", missing_required_field),
    "orphan-card": ("warn", orphan_card),
    "oversized-entry": ("warn", oversized_entry),
    "reference-not-wikilink": ("warn", reference_not_wikilink),
    "reference-vault-link": ("warn", reference_vault_link),
    "reference-wrong-type": ("warn", reference_wrong_type),
    "singleton-filename-mismatch": ("warn", singleton_filename_mismatch),
    "singleton-tag": ("warn", singleton_tag),
    "slug-filename-mismatch": ("warn", slug_filename_mismatch),
    "ticket-outward-only": ("warn", ticket_outward_only),
    "unintended-emphasis": ("warn", unintended_emphasis),
    "unknown-field": ("warn", unknown_field),
    "unknown-rel": ("warn", unknown_rel),
    "unquoted-frontmatter-link": ("warn", unquoted_frontmatter_link),
    "untagged-card": ("warn", untagged_card),
    "untyped-entry": ("warn", untyped_entry),
}
#: Parts of the structure that all rules together read.
PARTS = ("links", "headings", "nodes", "inlines", "unquoted")
#: The same without blocks and inlines that no rule looks at.
NARROW = ("links", "headings", "leads", "emphasis", "opens", "unquoted")


def severities(config: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Defaults, then the configuration, then the call; an unknown rule or severity is an error."""
    out = {name: severity for name, (severity, _) in RULES.items()}
    for layer in (config or {}, overrides or {}):
        for name, severity in layer.items():
            if name not in RULES:
                raise ValueError(f"unknown rule {name!r}")
            if severity not in ("off", "warn", "error"):
                raise ValueError(f"unknown severity {severity!r}")
            out[name] = severity
    return out


def findings(vault: Vault, config: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """(rule, severity, file, message) of all rules that are on, sorted by file, then rule."""
    parts = [RULES[name][1](vault).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "file", "message") for name, severity in severities(config, overrides).items() if severity != "off"]
    return reduce(DataFrame.unionByName, parts).orderBy(F.split("file", "/"), "rule", "message")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def exit_code(found: DataFrame) -> int:
    """1 if there is a finding that is an error."""
    return int(bool(found.where("severity = 'error'").take(1)))


def render(found: DataFrame, form: str = "text") -> str:
    """Findings as lines, as markdown by file, as JSON, or a count a rule; they stream to the driver."""
    if form == "summary":
        return "".join(f"{r.n:6d}  {r.rule}\n" for r in summary(found).orderBy(F.desc("n"), "rule").collect())
    rows = found.toLocalIterator()
    if form == "json":
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2)
    out, now = [], None
    for r in rows:
        if form == "markdown":
            if r.file != now:
                out += ["", f"### {r.file}", ""] if out else [f"### {r.file}", ""]
                now = r.file
            out.append(f"- **{r.rule}** ({r.severity}): {r.message}")
        else:
            out.append(f"{r.file}: {r.severity} [{r.rule}] {r.message}")
    return "\n".join(out) + "\n" if out else ""

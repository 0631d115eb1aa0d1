"""Notes as tables: each file crosses to Python once, as Arrow batches; only what was parsed comes back.

The text of a note stays on the JVM: its body is a part of it, cut where the parser says that it begins.
"""

from __future__ import annotations

import json
import posixpath
import re
import textwrap
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from notewell.functions import markdown, text, yaml12

VALUE = "struct<kind:string,display:string,num:double,bool:boolean,seq_len:int,items:array<string>,links:array<struct<target:string,alias:string>>,strings:array<string>>"
SPAN = "struct<start:bigint,`end`:bigint>"
PARTS = {
    "links": "array<struct<target:string,alias:string,line:int,embed:boolean>>",
    "headings": f"array<struct<seq:int,level:int,line:int,text:string,setext:boolean,start_col:int,span:{SPAN},address:string,parent_seq:int,sec_start:int,sec_end:int>>",
    "nodes": f"array<struct<seq:int,parent_seq:int,depth:int,type:string,span:{SPAN},start_line:int,end_line:int,info:string,body_span:{SPAN},ordered:boolean,tight:boolean,marker:string,number:int,task:boolean,header:boolean>>",
    "inlines": f"array<struct<seq:int,type:string,span:{SPAN},start_line:int,target:string,alias:string,embed:boolean,page:string,heading:string,block:string,url:string,title:string,inner:{SPAN},before:string,after:string,after_next:string,in_cell:boolean>>",
    "regions": f"array<struct<label:string,info:string,span:{SPAN},body_span:{SPAN},start_line:int,end_line:int>>",
    "dangling": "array<struct<kind:string,label:string,line:int>>",
    "unquoted": "array<struct<target:string,line:int>>",
    "fm_json": "string",
    "fields": "array<struct<key:string,value:string,line:int>>",
}
#: Narrow parts, which plain notes give without the block reader: emphasis of the inlines, the first paragraphs of quotes that
#: go past their first line, and whether a heading of the body comes before any other block.
PARTS |= {"emphasis": PARTS["inlines"], "leads": PARTS["nodes"], "opens": "boolean"}
#: Those, with what else plain notes give; and what each is made of in other notes.
PLAIN, MADE_OF = {"links", "headings", "emphasis", "leads", "opens"}, {"emphasis": ("inlines",), "leads": ("nodes",), "opens": ("headings", "nodes")}
#: Parts that the frontmatter alone gives.
FRONT = ("unquoted", "fm_json", "fields")
#: Keys of the frontmatter that the canonical columns are made of.
CANONICAL = ("description", "epistemic_status", "superseded", "tags", "template", "type")
_NUMBER = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)", re.I)
_UNQUOTED = re.compile(r"(?:^|[\s\[,:-])\[\[([^\[\]\n]+)\]\](?!['\"])")


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _strings(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from _strings(x)


def entry(value) -> dict:
    """A frontmatter value in the forms that operators compare."""
    if isinstance(value, str):
        # Most values are texts.
        links = [{"target": m[1].strip(), "alias": m[2]} for m in markdown.WIKI.finditer(value)] if "[[" in value else []
        return {"kind": "string", "display": value, "num": float(value) if _NUMBER.fullmatch(value) else None, "bool": {"true": True, "false": False}.get(value), "seq_len": 0, "items": [value], "links": links, "strings": [value]}
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "list" if isinstance(value, list) else "map"
    shown = yaml12.display(value)
    num = float(value) if kind == "number" else None
    strings = list(_strings(value))
    links = [{"target": m[1].strip(), "alias": m[2]} for s in strings if "[[" in s for m in markdown.WIKI.finditer(s)]
    return {
        "kind": kind,
        "display": shown,
        "num": num,
        "bool": value if kind == "bool" else None,
        "seq_len": len(value) if kind == "list" else 0,
        "items": [x for x in value if isinstance(x, str)] if kind == "list" else [],
        "links": links,
        "strings": strings,
    }


@lru_cache(1 << 15)
def _scalar_entry(kind: type, value) -> dict:
    return entry(value)


@lru_cache(1 << 13)
def _list_entry(kinds: tuple[type, ...], values: tuple) -> dict:
    return entry(list(values))


#: Characters up to which a text's entry is kept, so that what is kept stays small.
KEPT = 200


def _short(value) -> bool:
    return value is None or isinstance(value, (bool, int)) or (isinstance(value, str) and len(value) <= KEPT)


def _entry_of(value) -> dict:
    """``entry`` of a value, made once for equal ones; the types are asked too, since 1 and true are equal.

    Numbers with a point aren't kept: they rarely recur, and 0.0 equals -0.0.
    """
    if _short(value):
        return _scalar_entry(type(value), value)
    if isinstance(value, list) and len(value) <= KEPT and all(map(_short, value)):
        return _list_entry(tuple(map(type, value)), tuple(value))
    return entry(value)


def place_of(content: str) -> dict:
    """Where the body begins, in characters and lines."""
    block, first = markdown.body_of(content)
    # The body begins with the end of the line before it; what stands before that is left out, as is a byte order mark.
    plain = content.removeprefix("\ufeff")
    skipped = 0 if block is None else sum(len(x) + 1 for x in plain.split("\n", first)[:first]) - 1
    return {"body_at": len(content) - len(plain) + skipped, "body_start_line": first + 1}


def _unquoted(block: str) -> list[dict]:
    lines = enumerate(block.split("\n")) if "[[" in block else ()
    return [{"target": m[1], "line": i + 2} for i, line in lines if "[[" in line and not re.search(r"""["'][^"']*\[\[""", line) for m in _UNQUOTED.finditer(line)]


def front_of(content: str, parts: tuple[str, ...], keys: tuple[str, ...] | None = None) -> dict:
    """The frontmatter, of which only some keys may be asked for, and the parts that it alone gives."""
    if not {*parts} - {"unquoted"} and content.startswith("---\n") and (end := content.find("\n---\n", 3)) > 3:
        # No plain line ends a frontmatter, so if all are plain it ends here.
        fm = yaml12.picked(content[4:end], keys)
        if fm is not None:
            out = {"fm": [(k, _entry_of(v)) for k, v in fm.items()], "fm_error": None}
            return out | {"unquoted": _unquoted(content[4:end])} if parts else out
    block, _ = markdown.body_of(content)
    fm, error = {}, None
    if block is not None:
        try:
            fm = yaml12.load(block)
        except (ValueError, IndexError, RecursionError) as e:
            fm, error = {}, str(e)
    out = {"fm": [(k, _entry_of(v)) for k, v in sorted(fm.items()) if keys is None or k in keys], "fm_error": error}
    if "fm_json" in parts:
        out["fm_json"] = json.dumps(fm, ensure_ascii=False, default=str)
    if "fields" in parts:
        out["fields"] = fields_of(block or "")
    if "unquoted" in parts:
        out["unquoted"] = _unquoted(block or "")
    return out


def structure_of(content: str, parts: tuple[str, ...]) -> dict:
    """The parts that the structure gives."""
    if parts == ("links",) and (links := markdown.plain_links(content)) is not None:
        return {"links": links}
    if not MADE_OF.keys().isdisjoint(parts) and PLAIN.issuperset(parts) and (plain := markdown.plain_parts(content)) is not None:
        return {p: plain[p] for p in parts}
    read = tuple(dict.fromkeys(x for p in parts for x in MADE_OF.get(p, (p,))))
    note = markdown.structure(content, emphasis="inlines" in read, parts=read)
    out = {p: getattr(note, p) for p in parts if p not in ("links", *MADE_OF, *FRONT)}
    if "emphasis" in parts:
        out["emphasis"] = [x for x in note.inlines if x["type"] in ("Emph", "Strong")]
    if "leads" in parts:
        # Nodes are numbered in the order of the text, so a block's first child is the next one.
        out["leads"] = [n for n in note.nodes if n["type"] == "Paragraph" and n["seq"] and n["parent_seq"] == n["seq"] - 1 and n["end_line"] > n["start_line"] and note.nodes[n["parent_seq"]]["type"] == "BlockQuote"]
    if "opens" in parts:
        out["opens"] = bool(note.headings) and all(n["span"]["start"] > note.headings[0]["span"]["start"] for n in note.nodes if n["depth"] == 0)
    if "links" in parts:
        out["links"] = [{k: x[k] for k in ("target", "alias")} | {"line": x["start_line"], "embed": x["embed"]} for x in note.inlines if x["type"] == "Wikilink"]
    return out


def parse_one(content: str, parts: tuple[str, ...]) -> dict:
    out = front_of(content, parts) | place_of(content)
    return out | structure_of(content, parts) if set(parts) - set(FRONT) else out


def _rows(rows: list[dict], kind: pa.StructType) -> pa.Array:
    return pa.array(rows, kind)


def _fronts(rows: list[dict], kind: pa.StructType) -> pa.Array:
    """What ``front_of`` gives for some notes; an entry that many of them share is made once."""
    number: dict[int, int] = {}
    entries, keys, places, offsets = [], [], [], [0]
    for row in rows:
        for key, value in row["fm"]:
            at = number.setdefault(id(value), len(entries))
            if at == len(entries):
                entries.append(value)
            keys.append(key)
            places.append(at)
        offsets.append(len(keys))
    fm = kind.field("fm").type
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, fm.key_type), pa.array(entries, fm.item_type).take(pa.array(places, pa.int32()))).cast(fm)
    rest = [pa.array([row[f.name] for row in rows], f.type) for f in kind if f.name != "fm"]
    return pa.StructArray.from_arrays([maps, *rest], fields=list(kind))


def _reading(read: Callable[[str], dict], schema: StructType, made: Callable = _rows) -> Callable:
    """An Arrow function from texts to what ``read`` gives for each.

    Called deterministic, it would be evaluated again wherever a filter on its result is pushed down.
    """
    kind = pa.struct(list(to_arrow_schema(schema)))

    def run(contents: pa.Array) -> pa.Array:
        out = [made([read(c or "") for c in contents.slice(a, 512).to_pylist()], kind) for a in range(0, len(contents), 512)]
        return pa.concat_arrays(out) if out else pa.array([], kind)

    run.__annotations__ = {"contents": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema).asNondeterministic()


def fields_of(block: str) -> list[dict]:
    """The top-level fields of a frontmatter block in the order of its text, with their text, without its indent, and line."""
    out: list[dict] = []
    for i, line in enumerate(block.split("\n")):
        m = re.match(r"""("[^"]*"|'[^']*'|[^\s#:\-][^:]*?)\s*:(?:\s+(.*))?$""", line)
        if m:
            out.append({"key": m[1].strip("\"'"), "value": [(m[2] or "").strip()], "line": i + 2})
        elif out:
            out[-1]["value"].append(line)
    for f in out:
        rest = textwrap.dedent("\n".join(f["value"][1:])).rstrip()
        f["value"] = "\n".join(x for x in (f["value"][0], rest) if x)
    return out


def parse(files: DataFrame, *parts: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Notes from (rel, content): the canonical columns and the named parts of the structure.

    Only the parts that a query needs are computed.  What Catalyst can derive (folder, name, type, tier, tokens) is
    added as columns, so a query that doesn't read them doesn't pay for them.  A query that names the ``keys`` it reads
    gets a ``fm`` of these and of those that the columns are made of; the whole frontmatter is read for errors all the same.
    """
    if keys is not None:
        keys = tuple(sorted({*CANONICAL, *keys}))
    front, body = tuple(p for p in parts if p in FRONT), tuple(p for p in parts if p not in FRONT)
    schema = lambda *fields: _parse_datatype_string(", ".join(fields))
    # Each function is one column, so those that a query doesn't read are pruned and never called.
    columns = {"_place": _reading(place_of, schema("body_at int", "body_start_line int")), "_front": _reading(lambda c: front_of(c, front, keys), schema(f"fm map<string,{VALUE}>", "fm_error string", *(f"{p} {PARTS[p]}" for p in front)), _fronts)}
    if body:
        columns["_structure"] = _reading(lambda c: structure_of(c, body), schema(*(f"{p} {PARTS[p]}" for p in body)))
    notes = files.select("rel", "content", *(c for c in ("ctime",) if c in files.columns), *(f("content").alias(name) for name, f in columns.items()))
    plain = [c for c in notes.columns if c not in columns]
    notes = notes.select(*plain, "_front.fm", "_front.fm_error", "_place.body_at", "_place.body_start_line", *(f"{'_front' if p in FRONT else '_structure'}.{p}" for p in parts))
    notes = notes.withColumn("body", F.substr("content", F.col("body_at") + 1)).drop("body_at")
    field = lambda key, part: F.col("fm")[key][part]
    is_template = F.coalesce(field("template", "bool"), F.lit(False))
    return (
        notes.withColumn("name", F.regexp_replace(F.element_at(F.split("rel", "/", -1), -1), r"\.[^.]*$", ""))
        .withColumn("folder", F.when(F.instr("rel", "/") > 0, F.regexp_replace("rel", "/[^/]*$", "")).otherwise(""))
        .withColumn("type", text.shown(field("type", "display")))
        .withColumn("description", text.shown(field("description", "display")))
        .withColumn("tags", F.coalesce(field("tags", "items"), F.array().cast("array<string>")))
        .withColumn("is_template", is_template)
        .withColumn("tier", text.tier(F.col("fm")))
        .withColumn("lint_exempt", (F.col("tier") == "superseded") | is_template)
        .withColumn("tokens", text.tokens(F.col("body")))
    )


def links(notes: DataFrame, frontmatter: bool = True) -> DataFrame:
    """(rel, src_name, surface, ord, target, alias, line, embed, link_key): body links, then those of frontmatter."""
    body = notes.select("rel", F.col("name").alias("src_name"), F.lit("body").alias("surface"), F.posexplode("links").alias("ord", "l"))
    body = body.select("rel", "src_name", "surface", "ord", "l.target", "l.alias", "l.line", "l.embed")
    if not frontmatter:
        return body.withColumn("link_key", text.link_key(F.col("target")))
    front = notes.select("rel", F.col("name").alias("src_name"), F.lit("frontmatter").alias("surface"), F.posexplode(F.flatten(F.transform(F.map_values("fm"), lambda v: v["links"]))).alias("ord", "l"))
    front = front.select("rel", "src_name", "surface", "ord", "l.target", "l.alias", F.lit(None).cast("int").alias("line"), F.lit(False).alias("embed"))
    return body.unionByName(front).withColumn("link_key", text.link_key(F.col("target")))


def with_key(notes: DataFrame) -> DataFrame:
    return notes.withColumn("note_key", text.normalized(F.col("name")))


def fm_entries(notes: DataFrame) -> DataFrame:
    """(rel, key, kind, display, num, bool, seq_len): a row for each frontmatter key."""
    return notes.select("rel", F.explode("fm").alias("key", "v")).select("rel", "key", "v.kind", "v.display", "v.num", "v.bool", "v.seq_len")


def part(notes: DataFrame, name: str) -> DataFrame:
    """A part of the structure, a row for each of its items."""
    return notes.select("rel", F.explode(name).alias("_x")).select("rel", "_x.*")


def vault_rel(path: str, root: str) -> str:
    return posixpath.relpath(path, root)

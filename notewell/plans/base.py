"""View files: filters, formulas, order, sort, groups and summaries, compiled to columns before Spark sees a plan."""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from notewell.functions import text, yaml12
from notewell.operators import notes as N
from notewell.sources.shared import written


class BaseError(ValueError):
    """A view file that can't be compiled."""


@dataclass
class FilterSet:
    all: list[str] = field(default_factory=list)
    any: list[str] = field(default_factory=list)


@dataclass
class View:
    name: str
    filters: FilterSet
    order: list[str]
    sort: list[tuple[str, bool]]
    group: tuple[str, bool] | None
    summaries: dict[str, str]


@dataclass
class Base:
    filters: FilterSet
    formulas: dict[str, str]
    names: dict[str, str]
    views: list[View]

    def view(self, name: str) -> View:
        for v in self.views:
            if v.name == name:
                return v
        raise BaseError(f"no view {name!r}; there are {', '.join(v.name for v in self.views)}")


def _filters(value) -> FilterSet:
    if value is None:
        return FilterSet()
    if isinstance(value, str):
        return FilterSet(all=[value])
    if not isinstance(value, dict) or set(value) - {"and", "or"}:
        raise BaseError("filters are lists under and / or")
    return FilterSet([str(x) for x in value.get("and") or []], [str(x) for x in value.get("or") or []])


def _ascending(value) -> bool:
    # Only the exact word ascends; anything else, and nothing, descends.
    return value == "ASC"


def parse(source: str) -> Base:
    """The base of a view file.  Formulas are taken line by line as raw text, since they are no YAML."""
    kept, formulas, inside = [], {}, False
    for line in source.split("\n"):
        if inside and (not line.strip() or line.startswith((" ", "\t"))):
            if line.strip():
                name, colon, body = line.partition(":")
                if not colon:
                    raise BaseError(f"a formula without a colon: {line.strip()!r}")
                body = body.strip()
                formulas[name.strip()] = body[1:-1].replace("''", "'") if len(body) > 1 and body[0] == body[-1] == "'" else body
            continue
        inside = line.rstrip() == "formulas:"
        if not inside:
            kept.append(line)
    spec = yaml12.load("\n".join(kept))
    views = []
    for v in spec.get("views") or []:
        group = v.get("groupBy")
        views.append(View(
            str(v.get("name") or ""), _filters(v.get("filters")), [str(c) for c in v.get("order") or []],
            [(str(s["property"]), _ascending(s.get("direction"))) for s in v.get("sort") or []],
            (str(group["property"]), _ascending(group.get("direction"))) if group else None,
            {str(k): str(x) for k, x in (v.get("summaries") or {}).items()},
        ))
    names = {str(k): str((p or {}).get("displayName") or "") for k, p in (spec.get("properties") or {}).items()}
    return Base(_filters(spec.get("filters")), formulas, names, views)


#: Keys that the columns compiled by ``keys`` read.
_ASKED: ContextVar[set[str] | None] = ContextVar("_ASKED", default=None)


def entry(key: str) -> Column:
    if (asked := _ASKED.get()) is not None:
        asked.add(key)
    return F.col("fm")[key]


def prop(key: str) -> Column:
    return text.shown(entry(key)["display"])


_NAME = r"[\w-]+"
_STRING = r'"([^"]*)"'
FILTERS = [
    (rf"({_NAME})\s*==\s*{_STRING}", lambda m: prop(m[1]) == m[2]),
    (rf"({_NAME})\s*==\s*(true|false)", lambda m: F.coalesce(entry(m[1])["bool"] == (m[2] == "true"), F.lit(False))),
    (rf"(!?)file\.inFolder\({_STRING}\)", lambda m: ~text.in_folder(F.col("rel"), m[2]) if m[1] else text.in_folder(F.col("rel"), m[2])),
    (rf"({_NAME})\.containsAny\(\s*({_STRING}(?:\s*,\s*{_STRING})*)\s*\)", lambda m: F.coalesce(F.arrays_overlap(entry(m[1])["items"], F.array(*[F.lit(x) for x in re.findall(_STRING, m[2])])), F.lit(False))),
    (rf"(!?)({_NAME})\.isTruthy\(\)", lambda m: text.truthy(prop(m[2])) != bool(m[1])),
    (rf"({_NAME})\.length\s*>\s*(\d+)", lambda m: F.coalesce(entry(m[1])["seq_len"], F.lit(0)) > _size(m[2])),
]


def _size(digits: str) -> int:
    if int(digits) >= 1 << 63:
        raise BaseError(f"the length {digits} is out of range")
    return int(digits)


def compile_filter(expression: str) -> Column:
    """A filter expression as a column; one that isn't known is an error, never a filter that lets all pass."""
    body = expression.strip().strip("'")
    for pattern, build in FILTERS:
        if m := re.fullmatch(pattern, body):
            return build(m)
    raise BaseError(f"unsupported filter: {expression}")


def compile_set(filters: FilterSet) -> Column:
    parts = [compile_filter(e) for e in filters.all]
    if filters.any:
        parts.append(text.any_of([compile_filter(e) for e in filters.any]))
    return reduce(and_, parts, F.lit(True))


@dataclass
class Value:
    """A formula's value: what it shows, and the number that it is, if any."""

    show: Column
    num: Column

    @staticmethod
    def of_number(num: Column) -> Value:
        return Value(text.shown(text.format_number(num)), num)


class Formula:
    """A recursive reading of the formula language: literals, properties, if, + - * /, round, parentheses.

    What doesn't compute as numbers falls back to the property that the whole text names, so ``due-date`` is a
    property unless both sides of the sign are numbers.
    """

    def expression(self, source: str) -> Value:
        s = source.strip()
        if not s:
            return Value(F.lit(""), F.lit(None).cast("double"))
        if len(s) > 1 and s[0] == s[-1] == '"' and '"' not in s[1:-1]:
            # A text that is a number counts as one.
            return Value(F.lit(s[1:-1]), text.number(F.lit(s[1:-1])))
        if s.startswith("if(") and self.closes(s, 2) == len(s) - 1 and len(args := self.arguments(s[3:-1])) >= 3:
            yes, no, cond = self.expression(args[1]), self.expression(",".join(args[2:])), self.condition(args[0])
            return Value(F.when(cond, yes.show).otherwise(no.show), F.when(cond, yes.num).otherwise(no.num))
        if s.endswith(")") and (m := re.fullmatch(r"(.*)\.round\(\s*(\d*)\s*\)", s, re.S)) and self.top_level(m[1]):
            inner = self.expression(m[1])
            num = text.rounded(inner.num, int(m[2] or 0))
            return Value(F.when(inner.num.isNotNull(), text.format_number(num)).otherwise(inner.show), num)
        if s[0] == "(" and self.closes(s, 0) == len(s) - 1:
            return self.expression(s[1:-1])
        fallback = self.leaf(s)
        for signs in ("+-", "*/"):
            if (at := self.last(s, signs)) is not None:
                left, right = self.expression(s[:at]), self.expression(s[at + 1 :])
                both = left.num.isNotNull() & right.num.isNotNull()
                num = {"+": left.num + right.num, "-": left.num - right.num, "*": left.num * right.num, "/": F.when(right.num == 0, 0.0).otherwise(left.num / F.nullif(right.num, F.lit(0.0)))}[s[at]]
                fallback = Value(F.when(both, text.format_number(num)).otherwise(fallback.show), F.when(both, num).otherwise(fallback.num))
                if signs == "+-":
                    # The lowest sign counts; what binds closer is read within its sides.
                    return fallback
        return fallback

    def leaf(self, s: str) -> Value:
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
            return Value.of_number(F.lit(float(s)))
        if s in ("true", "false"):
            return Value(F.lit(s), F.lit(None).cast("double"))
        num = entry(s)["num"]
        return Value(F.when(num.isNotNull(), text.format_number(num)).otherwise(prop(s)), num)

    def condition(self, source: str) -> Column:
        s = source.strip()
        for sign in (" == ", " != ", " > ", " < "):
            if sign in s:
                a, b = (self.expression(x) for x in s.split(sign, 1))
                if sign == " == ":
                    return a.show == b.show
                if sign == " != ":
                    return a.show != b.show
                more = a.num > b.num if sign == " > " else a.num < b.num
                # A side that is no number leaves the text to be read as a whole: a literal, or a property of that name.
                return F.coalesce(more, text.truthy(self.whole(s)))
        return text.truthy(self.expression(s).show)

    @staticmethod
    def whole(s: str) -> Column:
        """What a text shows that is no comparison: what stands between its outermost quotes, or a property."""
        return F.lit(s[1:-1]) if len(s) > 1 and s[0] == s[-1] == '"' else prop(s)

    @staticmethod
    def depths(s: str):
        depth, quoted = 0, False
        for i, c in enumerate(s):
            quoted ^= c == '"'
            depth += 0 if quoted else (c == "(") - (c == ")")
            yield i, c, depth, quoted

    def closes(self, s: str, at: int) -> int:
        return next((i for i, c, depth, quoted in self.depths(s[at:]) if depth == 0 and c == ")" and not quoted), -1 - at) + at

    def top_level(self, s: str) -> bool:
        return all(depth == 0 or s[0] == "(" for _, _, depth, _ in self.depths(s)) and (self.last(s, "+-*/") is None or s[0] == "(")

    def last(self, s: str, signs: str) -> int | None:
        return next((i for i, c, depth, quoted in reversed(list(self.depths(s))) if c in signs and depth == 0 and not quoted and i > 0 and not (c in "+-" and s[i - 1] in "eE" and s[:i - 1].strip().replace(".", "").isdigit())), None)

    def arguments(self, s: str) -> list[str]:
        cuts = [i for i, c, depth, quoted in self.depths(s) if c == "," and depth == 0 and not quoted]
        return [s[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(s)], strict=True)]


def column(name: str, formulas: dict[str, Column]) -> Column:
    """What a view's column shows: file.*, formula.*, or a property without its link signs."""
    if name == "file.name":
        return F.col("name")
    if name == "file.folder":
        return F.col("folder")
    if name == "file.ctime":
        return text.shown(F.date_format("ctime", "yyyy-MM-dd HH:mm"))
    if name.startswith("formula."):
        return formulas.get(name.removeprefix("formula."), F.lit(""))
    return text.strip_links(prop(name.removeprefix("note.")))


def candidates(name: str) -> list[str]:
    return [f"note.{name}", f"file.{name}", name]


def header(base: Base, name: str) -> str:
    return next((base.names[c] for c in candidates(name) if base.names.get(c)), name.removeprefix("formula.").removeprefix("note.").removeprefix("file."))


def run(base: Base, view_name: str, notes: DataFrame, extra: Column | None = None) -> DataFrame:
    """A view's rows: its columns c0, c1, ... as texts, ``_group``, ``_rel`` and the sort keys ``_k0``, ...

    Filters come first, so they are pushed below everything else.  The rows are in no order: ``ordered`` puts them in
    the view's, and the renderers do.  The result carries headers and directions in the columns' metadata.
    """
    view = base.view(view_name)
    kept = notes.where(compile_set(base.filters) & compile_set(view.filters) & (extra if extra is not None else F.lit(True)))
    formulas = {k: Formula().expression(v).show for k, v in base.formulas.items()}
    keys = [(column(c, formulas), up) for c, up in view.sort]
    out = [column(c, formulas).alias(f"c{i}", metadata={"header": header(base, c), "source": c}) for i, c in enumerate(view.order)]
    group = column(view.group[0], formulas) if view.group else F.lit(None).cast("string")
    if view.group:
        keys.insert(0, (group, view.group[1]))
    return kept.select(*out, group.alias("_group"), F.col("rel").alias("_rel"), *[k.alias(f"_k{i}", metadata={"up": up}) for i, (k, up) in enumerate(keys)])


def keys(base: Base, view_name: str, notes: DataFrame) -> tuple[str, ...]:
    """The frontmatter keys that ``run`` reads for a view, over notes such as ``notes``."""
    asked: set[str] = set()
    token = _ASKED.set(asked)
    try:
        run(base, view_name, notes)
    finally:
        _ASKED.reset(token)
    return tuple(sorted(asked))


def run_files(base: Base, view_name: str, files: DataFrame) -> DataFrame:
    """``run`` over (rel, content); of the frontmatter only what the view reads is made."""
    return run(base, view_name, N.parse(files, keys=keys(base, view_name, N.parse(files, keys=()))))


def sort_keys(rows: DataFrame) -> list[Column]:
    """The order of a view's rows: texts compared byte by byte, with the path last, so the order is total."""
    keys = [F.col(f.name).asc() if f.metadata["up"] else F.col(f.name).desc() for f in rows.schema.fields if "up" in f.metadata]
    return [*keys, F.col("_rel").asc()]


def ordered(rows: DataFrame) -> DataFrame:
    """A view's rows in order, without the sort keys.

    An order over all rows samples them first; dealing the few finished columns out before keeps the notes from being
    parsed for the sample and again for the result.
    """
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_rel")
    return dealt.orderBy(*sort_keys(rows)).select(*[f.name for f in rows.schema.fields if "up" not in f.metadata])


def summaries(base: Base, view_name: str, rows: DataFrame) -> DataFrame:
    """One row with a text for each column of a view: Sum or Average over all its rows, else empty."""
    view = base.view(view_name)
    out = []
    for i, name in enumerate(view.order):
        op = next((view.summaries[c] for c in [*candidates(name)] if c in view.summaries), "")
        num = text.number(F.col(f"c{i}"))
        if op == "Sum":
            out.append(text.format_number(F.coalesce(F.sum(num), F.lit(0.0))).alias(f"c{i}"))
        elif op == "Average":
            out.append(F.when(F.avg(num).isNull(), "").otherwise(F.format_string("%.3f", F.avg(num))).alias(f"c{i}"))
        else:
            out.append(F.first(F.lit("")).alias(f"c{i}"))
    return rows.agg(*out)


class PrecheckError(ValueError):
    """A condition that some note of the whole scan must meet, and none does."""


class Precheck:
    """Conditions that some note must meet, gathered in the same pass as a view.

    A view that filters its notes down to none can't tell a name that nothing has from one whose notes are all done; the
    conditions are counted over all notes, before any filter, while the view is computed, and ``verify`` fails the call
    afterwards.  ``must`` gives a condition for each message.
    """

    def __init__(self, must: dict[str, Column]):
        self.must, self.seen = must, Observation()

    def over(self, notes: DataFrame) -> DataFrame:
        """The same notes; what is computed from them gathers the conditions."""
        return notes.observe(self.seen, *[F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)).alias(f"c{i}") for i, c in enumerate(self.must.values())])

    def verify(self) -> None:
        """After the view was collected or written: an error with the messages of all conditions that no note meets.

        Rows that stream to the driver (``toLocalIterator``) report nothing, and this would wait for it.
        """
        got = self.seen.get
        if missing := [message for i, message in enumerate(self.must) if not got[f"c{i}"]]:
            raise PrecheckError("; ".join(missing))


def render_checked(base: Base, view_name: str, notes: DataFrame, must: dict[str, Column], extra: Column | None = None) -> str:
    """A view as a table, or an error if some condition of ``must`` holds for no note; the notes are read once."""
    check = Precheck(must)
    rows = written(run(base, view_name, check.over(notes), extra), "view")
    check.verify()
    return render_table(rows)


def _headers(rows: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.metadata["header"]) for f in rows.schema.fields if "header" in f.metadata]


def _cell(value: str) -> str:
    return value.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").replace("\r", " ")


def render_table(rows: DataFrame, summary: list[str] | None = None) -> str:
    """A markdown table a group; the rows stream to the driver one partition at a time."""
    heads = _headers(rows)
    out: list[str] = []
    now: object = out
    for r in ordered(rows).toLocalIterator():
        if r["_group"] != now:
            _close(out, summary, bool(now is not out))
            now = r["_group"]
            if now is not None:
                out += [f"### {now}", ""]
            out += ["| " + " | ".join(_cell(h) for _, h in heads) + " |", "| " + " | ".join("---" for _ in heads) + " |"]
        out.append("| " + " | ".join(_cell(r[c]) for c, _ in heads) + " |")
    _close(out, summary, now is not out)
    return "\n".join(out).rstrip("\n") + "\n" if out else ""


def _close(out: list[str], summary: list[str] | None, begun: bool) -> None:
    if begun:
        if summary:
            out.append("| " + " | ".join(f"**{_cell(s)}**" if s else "" for s in summary) + " |")
        out.append("")


def render_json(rows: DataFrame) -> str:
    import json

    heads = _headers(rows)
    grouped = lambda r: {} if r["_group"] is None else {"_group": r["_group"]}
    return json.dumps([grouped(r) | {h: r[c] for c, h in heads} for r in ordered(rows).toLocalIterator()], ensure_ascii=False, indent=2)


def render_tsv(rows: DataFrame) -> str:
    heads = _headers(rows)
    clean = lambda s: re.sub(r"[\t\r\n]+", " ", s)
    lines, grouped = [], False
    for r in ordered(rows).toLocalIterator():
        grouped = r["_group"] is not None
        lines.append("\t".join(([clean(r["_group"])] if grouped else []) + [clean(r[c]) for c, _ in heads]))
    return "\n".join(["\t".join((["group"] if grouped else []) + [h for _, h in heads]), *lines]) + "\n"

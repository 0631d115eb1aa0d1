"""Guarded rewrites of a note: line ends, gaps between blocks, tables and list markers."""

from __future__ import annotations

import re
from functools import lru_cache

from notewell.functions.markdown import Note, block_lines, body_of, structure
from notewell.functions.payload import display_width

RULES = ("endings", "gaps", "tables", "markers")


def endings(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text)


#: The rules look at the same few texts one after the other, so the last ones are kept as they were read.
@lru_cache(4)
def _note(text: str) -> Note:
    return structure(text, emphasis=False)


@lru_cache(4)
def _kinds(text: str) -> tuple[str, ...]:
    return tuple(block_lines(text.split("\n"), body_of(text)[1]))


def block_spans(text: str) -> list[tuple[str, int, int]]:
    """(type, first, last) of the frontmatter and of each block and heading of the top level, in lines from 1, in order."""
    note = _note(text)
    _, first = body_of(text)
    spans = [("FrontMatter", 1, first)] if first else []
    spans += [(n["type"], n["start_line"], n["end_line"]) for n in note.nodes if n["depth"] == 0]
    spans += [("Heading", h["line"], h["line"] + text_lines(text, h)) for h in note.headings]
    return sorted(spans, key=lambda x: x[1])


def text_lines(text: str, heading: dict) -> int:
    """Lines of a heading beyond its first: those of its text and its underline."""
    raw = text.encode("utf-8", "surrogatepass")[heading["span"]["start"] : heading["span"]["end"]]
    return raw.count(b"\n")


def check_partition(text: str) -> list[int]:
    """The lines that no block claims, or more than one does; lines of white space belong to the gaps between them."""
    claims = [0] * (text.count("\n") + 2)
    for _, first, last in block_spans(text):
        for i in range(first, last + 1):
            claims[i] += 1
    return [i for i, line in enumerate(text.split("\n"), 1) if claims[i] > 1 or (claims[i] == 0 and line.strip())]


def signatures(text: str) -> dict[str, list]:
    """What a rewrite must not change, in five readings, each of which sees what others don't.

    ``kinds``: blocks and headings, their order and nesting.  ``rich``: levels and underlines, info of fences, numbers
    of items and cells.  ``text``: links, code and regions, and the words.  ``tables``: cells as they stand in the
    source.  ``markers``: the signs that begin list items.
    """
    note = _note(text)
    lines = text.split("\n")
    spans = block_spans(text)
    bodies = [(kind, lines[first - 1 : last]) for kind, first, last in spans if kind != "FrontMatter"]
    code = [x for kind, part in bodies if kind == "CodeBlock" for x in part]
    words = re.findall(r"\w+", "\n".join(x for kind, part in bodies if kind != "Table" for x in part))
    marks = [m[1] if m[1] in "-*+" else m[1][-1] for kind, part in bodies if kind == "List" for x in part if (m := re.match(r"\s*([-*+]|\d{1,9}[.)])(?:\s|$)", x))]
    return {
        "kinds": [(n["type"], n["depth"]) for n in note.nodes] + [kind for kind, _, _ in spans],
        "rich": [(h["level"], h["setext"], h["text"]) for h in note.headings] + [part[0].strip() for kind, part in bodies if kind == "CodeBlock"] + [sum(n["parent_seq"] == x["seq"] for n in note.nodes) for x in note.nodes if x["depth"] == 0],
        "text": [*code, *words, *[(x["type"], x.get("target"), x.get("url")) for x in note.inlines], *[(r["label"], r["info"]) for r in note.regions]],
        "tables": [_cells(x) for kind, part in bodies if kind == "Table" for k, x in enumerate(part) if k != 1],
        "markers": marks,
    }


def differences(before: str, after: str, exempt: str = "") -> list[str]:
    """The signatures in which two texts differ, the one left out that a rule may change by its name."""
    a, b = signatures(before), signatures(after)
    return [name for name in a if name != exempt and a[name] != b[name]]


def gaps(text: str) -> str:
    """One blank line between top-level blocks, one newline at the end."""
    lines = text.split("\n")
    _, first = body_of(text)
    kinds = _kinds(text)
    out = lines[:first]
    blank = False
    for line, kind in zip(lines[first:], kinds[first:], strict=True):
        if kind == "blank":
            blank = True
            continue
        if blank and out:
            out.append("")
        blank = False
        if out and kind == "atx" and out[-1].strip() and len(out) > first:
            out.append("")
        out.append(line)
        if kind == "atx":
            blank = True
    return "\n".join(out).rstrip("\n") + "\n" if any(x.strip() for x in out) else text


def _cells(row: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|\s*$", "", re.sub(r"^\s*\|", "", row)))]


def tables(text: str) -> str:
    """Cells padded to their column's width, 3 at least; the last column isn't, if it is aligned to the left."""
    lines = text.split("\n")
    _, first = body_of(text)
    kinds = _kinds(text)
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and kinds[j] == "table":
            j += 1
        if j - i >= 2:
            rows = [_cells(x) for x in lines[i:j]]
            if len({len(r) for r in rows}) == 1:
                width = [max(3, *(display_width(r[c]) for k, r in enumerate(rows) if k != 1)) for c in range(len(rows[0]))]
                marks = rows[1]
                last = len(width) - 1
                for k, row in enumerate(rows):
                    if k == 1:
                        cells = [(":" if m.startswith(":") else "-") + "-" * ((3 if c == last and not m.endswith(":") else w) - 2) + (":" if m.endswith(":") else "-") for c, (m, w) in enumerate(zip(marks, width, strict=True))]
                    else:
                        cells = [x if c == last and not marks[c].endswith(":") else " " * (w - display_width(x)) + x if marks[c].endswith(":") and not marks[c].startswith(":") else x + " " * (w - display_width(x)) for c, (x, w) in enumerate(zip(row, width, strict=True))]
                    lines[i + k] = "| " + " | ".join(cells) + " |"
        i = max(j, i + 1)
    return "\n".join(lines)


def markers(text: str) -> str:
    """Bullets as -, ordered items as ``1.``; lists whose kinds stand side by side are left, since they would join."""
    lines = text.split("\n")
    _, first = body_of(text)
    kinds = _kinds(text)
    for i, kind in enumerate(kinds):
        if kind == "item" and (m := re.match(r"( *)([*+]|\d{1,9}\))(\s|$)", lines[i])):
            lines[i] = m[1] + ("-" if m[2] in "*+" else m[2][:-1] + ".") + lines[i][m.end(2) :]
    return "\n".join(lines)


def _kept_bytes(a: str, b: str) -> bool:
    plain = lambda s: [re.sub(r"\s", "", x) for x in s.split("\n") if x.strip() and not re.fullmatch(r"[\s|:-]+", x)]
    return plain(a) == plain(b)


def _mixed(text: str) -> bool:
    found = re.findall(r"(?m)^ {0,3}([-*+]|\d{1,9}[.)])\s", text)
    return len({x if x in "-*+" else x[-1] for x in found if x in "-*+"}) > 1 or len({x[-1] for x in found if x not in "-*+"}) > 1


@lru_cache(8)
def apply(rule: str, text: str) -> tuple[str, bool]:
    """A rule's result, and whether it was declined because a guard failed."""
    if rule == "endings":
        return endings(text), False
    if rule == "markers" and _mixed(text):
        return text, True
    new = {"gaps": gaps, "tables": tables, "markers": markers}[rule](text)
    if new == text:
        return text, False
    right = not check_partition(text) and not differences(text, new, "markers" if rule == "markers" else "")
    if rule in ("gaps", "tables"):
        right &= _kept_bytes(text, new)
    else:
        right &= len(new) == len(text) and all(x == y or (x in "*+" and y == "-") or (x == ")" and y == ".") for x, y in zip(text, new, strict=True))
    return (new, False) if right else (text, True)


def format_note(text: str) -> tuple[str, list[str]]:
    """All rules one after the other, and the names of those that were declined."""
    declined = []
    for rule in RULES:
        text, no = apply(rule, text)
        if no:
            declined.append(rule)
    return text, declined


def check(text: str) -> list[str]:
    """The rules of whose normal form a text departs, each seen alone; but for the first, lines end with LF."""
    plain = endings(text)
    return [rule for rule in RULES if (apply(rule, text)[0] != text if rule == "endings" else apply(rule, plain)[0] != plain)]

"""The structure of a note in one pass: blocks, headings, inlines, wikilinks and regions, in UTF-8 byte spans.

Blocks (``blocks``) and inlines (``inlines``) are those of CommonMark with GFM tables, task items, strikethrough and bare
addresses, plus wikilinks and their embeds; footnotes are text.  Here they are put into rows: headings of the top level
with their sections, other blocks with what they stand in, inlines in the order of the text, ``<!-- label -->`` regions.
What no block claims is a node too: link definitions, and anything else as ``Unknown``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np

from notewell.functions.blocks import ATX, Block, Reader
from notewell.functions.inlines import WIKI, inlines

__all__ = ["WIKI", "Note", "block_lines", "body_of", "plain_links", "plain_parts", "split_lines", "structure"]

REGION = re.compile(r"<!--\s*(/?)\s*([A-Za-z][\w-]*)\s*(?::\s*(.*?))?\s*-->")


@dataclass
class Note:
    """What was found; spans are bytes, lines count from 1."""

    headings: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    inlines: list[dict] = field(default_factory=list)
    regions: list[dict] = field(default_factory=list)
    dangling: list[dict] = field(default_factory=list)


def split_lines(text: str) -> list[str]:
    """Lines without their ends; LF, CRLF and CR all end one, and a last empty line is no line."""
    lines = re.split(r"\r\n|\n|\r", text)
    return lines[:-1] if lines and lines[-1] == "" else lines


def body_of(content: str) -> tuple[str | None, int]:
    """The frontmatter block and the index of the line on which the body begins (None, 0 without one)."""
    text = content.removeprefix("\ufeff")
    end = text.find("\n")
    if end < 0 or text[:end].strip() != "---":
        return None, 0
    begin, i = end + 1, 0
    # Line by line, since a body is long and mostly of no matter here.
    while end >= 0:
        at, i = end + 1, i + 1
        end = text.find("\n", at)
        if (text[at:] if end < 0 else text[at:end]).strip() == "---":
            return text[begin : max(begin, at - 1)], i + 1
    return None, 0


#: Lines that can make a heading.
HEADING = re.compile(r"(?m)^ {0,3}(?:#{1,6}(?:[ \t]|\r?$)|(?:=+|-+)[ \t]*\r?$)")


def _lines_of(content: str) -> tuple[list[str], list[int]]:
    """The lines without their ends and a byte order mark, and where each begins."""
    if "\r" not in content:
        lines = content.split("\n")
        starts = [0, *accumulate(len(x) + 1 for x in lines)]
        starts.pop()
        if content.startswith("\ufeff"):
            lines[0], starts[0] = lines[0][1:], 1
        if len(lines) > 1 and lines[-1] == "":
            lines.pop()
        return lines, starts
    starts, ends = [0], []
    for m in re.finditer(r"\r\n|\n|\r", content):
        ends.append(m.start())
        starts.append(m.end())
    ends.append(len(content))
    if content.startswith("\ufeff"):
        starts[0] = 1
    lines = [content[a:b] for a, b in zip(starts, ends, strict=True)]
    if len(lines) > 1 and lines[-1] == "":
        lines.pop()
    return lines, starts


def _walk(root: Block) -> Iterator[tuple[Block, int, Block | None]]:
    """All blocks but the root in the order of the text: block, depth, and the block that it stands in."""
    todo = [(c, 0, None) for c in reversed(root.children)]
    while todo:
        block, depth, parent = todo.pop()
        yield block, depth, parent
        todo.extend((c, depth + 1, block) for c in reversed(block.children))


def block_lines(lines: list[str], first: int = 0) -> list[str]:
    """For each line its kind: front, code, fence, blank, atx, setext, break, item, quote, table, html, definition or text."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    kinds = ["front"] * first + ["definition" if x.strip() else "blank" for x in lines[first:]]

    def mark(a: int, b: int, kind: str) -> None:
        kinds[a : b + 1] = [kind if kind == "code" or lines[i].strip() else "blank" for i in range(a, b + 1)]

    quoted = 0
    blocks = [x for x, _, _ in _walk(Reader("\n".join(lines), lines, starts, first).root)]
    for block in blocks:
        if block.start < quoted:
            continue
        kind = {"Table": "table", "ThematicBreak": "break", "HtmlBlock": "html", "BlockQuote": "quote", "Paragraph": "text"}.get(block.type)
        if block.type == "Heading":
            mark(block.first, block.last, "text" if block.data["setext"] else "atx")
            if block.data["setext"]:
                kinds[block.last] = "setext"
        elif block.type == "CodeBlock":
            mark(block.first, block.last, "code")
            if block.data["fenced"]:
                kinds[block.first] = "fence"
                if "closed" in block.data:
                    kinds[block.last] = "fence"
        elif kind and not (block.type in ("TableRow", "TableCell")):
            mark(block.first, block.last, kind)
        if block.type == "BlockQuote":
            quoted = block.end
    for block in blocks:
        if block.type == "ListItem" and kinds[block.first] != "quote":
            kinds[block.first] = "item"
    return kinds


def structure(content: str, emphasis: bool = True, parts: tuple[str, ...] | None = None) -> Note:
    """The structure of a note, or the named parts of it; positions are those of ``content``."""
    note = Note()
    asked = lambda *names: parts is None or any(n in parts for n in names)
    wanted = asked("nodes", "inlines") or (asked("headings") and HEADING.search(content)) or (asked("links") and "[[" in content) or (asked("regions", "dangling") and "<!--" in content)
    if not wanted:
        return note
    lines, starts = _lines_of(content)
    _, first = body_of(content)
    reader = Reader(content, lines, starts, first)
    places = None if content.isascii() else np.concatenate([[0], np.cumsum(_widths(content))])
    at = (lambda x: x) if places is None else (lambda x: int(places[x]))
    span = lambda a, b: {"start": at(a), "end": at(b)}
    line_of = lambda x: bisect.bisect_right(starts, x)
    blocks = list(_walk(reader.root)) if asked("nodes", "inlines", "links", "regions", "dangling") else []
    for block in reader.root.children if asked("headings") else ():
        if block.type == "Heading":
            text = " ".join([content[a:b].strip() for a, b in block.pieces])
            column = block.start - starts[block.first] + 1
            note.headings.append({"level": block.data["level"], "line": block.first + 1, "text": text, "setext": block.data["setext"], "start_col": column, "span": span(block.start, block.end)})
    if note.headings:
        _sections(note.headings, len(lines))
    if asked("nodes"):
        _nodes(note, blocks, lines, starts, first, span)
    only_links = not asked("inlines", "regions", "dangling")
    if not only_links or asked("links"):
        in_table = {id(c) for row, _, _ in blocks if row.type == "TableRow" for c in row.children}
        for block, _, _ in blocks:
            if block.pieces and block.type in ("Paragraph", "Heading", "TableCell") and not (only_links and content.find("[[", block.pieces[0][0], block.pieces[-1][1]) < 0):
                _inlines(note, content, block, id(block) in in_table, reader.names, emphasis, span, line_of)
        note.inlines.sort(key=lambda x: (x["span"]["start"], -x["span"]["end"]))
        for i, x in enumerate(note.inlines):
            x["seq"] = i
    if asked("regions", "dangling"):
        _regions(note, content, blocks, starts, span, line_of)
    return note


#: Signs that make more of a text than words and wikilinks.
_INTRICATE = re.compile(r"[\\`!<@]|://|www\.|\]\(")


def _wikilinks(text: str, line: int) -> Iterator[dict]:
    """The wikilinks of a leaf whose text begins on a line."""
    if _INTRICATE.search(text):
        found = ((x.start, x.more["target"], x.more["alias"], x.more["embed"]) for x in inlines(text, {}, False) if x.kind == "Wikilink")
    else:
        found = ((m.start(), m[1].strip(), m[2] and m[2].strip(), False) for m in WIKI.finditer(text) if m[1].strip())
    for at, target, alias, embed in found:
        yield {"target": target, "alias": alias, "line": line + text.count("\n", 0, at), "embed": embed}


#: A list item of one line that is plain text, or such a task.
_ITEM = re.compile(r"- (?:\[[ xX]\] )?[^\W\d_]")


def plain_parts(content: str) -> dict | None:
    """What lint rules ask of a plain note: its links and headings, whether a heading comes first, no emphasis, no quotes."""
    headings: list[dict] = []
    links = plain_links(content, headings)
    if links is None:
        return None
    if ("*" in content or "_" in content) and any("*" in x or "_" in x for x in content.split("\n")[body_of(content)[1] :]):
        return None
    return {"links": links, "headings": headings, "opens": bool(headings) and headings[0].pop("opens"), "emphasis": [], "leads": []}


def plain_links(content: str, headings: list[dict] | None = None) -> list[dict] | None:
    """The wikilinks of a note of plain blocks outside of each other; None if only ``structure`` can tell.

    Plain are paragraphs whose lines begin with a letter or a code span, headings with signs, closed fences, rows of bars
    without links, and list items of one line.  Whatever follows the last link is of no matter once its leaf has ended,
    unless the headings are asked for too.
    """
    if "[[" not in content and headings is None:
        return []
    if "\r" in content or content.startswith("\ufeff"):
        return None
    first, last = body_of(content)[1], content.rfind("[[")
    lines, out = content.split("\n"), []
    # The last line that holds a link.
    until = content.count("\n", 0, last)
    paragraph: list[str] = []
    begun, fence, item, opens = 0, "", False, True
    place = sum(len(x) + 1 for x in lines[:first]) if headings is not None else 0

    def close() -> None:
        if paragraph and "[[" in (text := "\n".join(paragraph)):
            out.extend(_wikilinks(text, begun + 1))
        paragraph.clear()

    for i in range(first, len(lines)):
        line = lines[i]
        start, place = place, place + len(line) + 1
        if fence:
            if line.startswith(fence) and not line.strip(" \t").strip(fence[0]):
                fence = ""
            elif line[:1] in (" ", "\t") and line.lstrip().startswith(fence):
                return None
            continue
        if not line:
            close()
            item = False
            if i > until and headings is None:
                break
            continue
        sign = line[0]
        if item and not (sign == "-" and _ITEM.match(line)):
            # What follows an item may go on with it.
            return None
        if sign.isalpha():
            if not paragraph:
                begun = i
            paragraph.append(line)
        elif sign == "`":
            if not line.startswith("```"):
                if not paragraph:
                    begun = i
                paragraph.append(line)
                opens = False
                continue
            fence = line[: len(line) - len(line.lstrip("`"))]
            if "`" in line[len(fence) :]:
                return None
            close()
        elif sign == "#" and (m := ATX.match(line)):
            close()
            text = line[m.end() :].rstrip(" \t")
            if text.endswith("#"):
                return None
            if headings is not None:
                if not text or line[-1].isspace():
                    return None
                at = start if content.isascii() else len(content[:start].encode("utf-8", "surrogatepass"))
                end = at + (len(line) if line.isascii() else len(line.encode("utf-8", "surrogatepass")))
                headings.append({"level": len(m[1]), "line": i + 1, "text": text.strip(), "setext": False, "start_col": 1, "span": {"start": at, "end": end}, **({} if headings else {"opens": opens})})
            if "[[" in text:
                out.extend(_wikilinks(text, i + 1))
        elif sign == "-" and _ITEM.match(line):
            close()
            begun, item = i, True
            paragraph.append(line[2:])
        elif sign == "|" and not paragraph and "[[" not in line and (i == first or not lines[i - 1] or lines[i - 1][0] in "#|") and (i + 1 == len(lines) or lines[i + 1][:1] in ("", "|")):
            # A table, or a paragraph, of rows alone.
            opens = False
            continue
        else:
            return None
        opens = False
    close()
    if headings:
        _sections(headings, len(lines) - (len(lines) > 1 and not lines[-1]))
    return out


def _widths(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def _nodes(note: Note, blocks: list, lines: list[str], starts: list[int], first: int, span) -> None:
    """Blocks but headings, and what none of them claims."""
    rows, claimed = [], set(range(first))
    for block, depth, parent in blocks:
        if depth == 0:
            claimed.update(range(block.first, block.last + 1))
        if block.type != "Heading":
            rows.append((block.start, depth, block, parent))
    i = first
    while i < len(lines):
        if i in claimed or not lines[i].strip(" \t"):
            i += 1
            continue
        j = i
        while j + 1 < len(lines) and j + 1 not in claimed and lines[j + 1].strip(" \t"):
            j += 1
        lead = len(lines[i]) - len(lines[i].lstrip(" \t"))
        kind = "LinkReferenceDefinition" if lines[i].lstrip(" \t").startswith("[") and "]:" in lines[i] else "Unknown"
        gap = Block(kind, starts[i] + lead, starts[j] + len(lines[j].rstrip(" \t")), i)
        gap.last = j
        rows.append((gap.start, 0, gap, None))
        i = j + 1
    rows.sort(key=lambda r: (r[0], r[1]))
    number = {id(r[2]): n for n, r in enumerate(rows)}
    for seq, (_, depth, block, parent) in enumerate(rows):
        data = block.data
        node = {"seq": seq, "parent_seq": None if parent is None else number[id(parent)], "depth": depth, "type": block.type, "span": span(block.start, block.end), "start_line": block.first + 1, "end_line": block.last + 1}
        if block.type == "CodeBlock":
            body = (block.start, block.end)
            if data["fenced"]:
                begin = min(starts[block.first + 1] if block.first + 1 < len(starts) else block.end, block.end)
                before = block.last - 1 if "closed" in data else block.last
                body = (begin, max(begin, starts[before] + len(lines[before])))
            node |= {"info": data.get("info"), "body_span": span(*body)}
        elif block.type == "List":
            node |= {"ordered": data["ordered"], "tight": data["tight"], "marker": data["marker"], "number": data["number"]}
        elif block.type == "ListItem":
            node["task"] = data["task"]
        elif block.type == "TableRow":
            node["header"] = data["header"]
        note.nodes.append(node)


def _sections(headings: list[dict], total: int) -> None:
    """Section ends and dotted addresses, from the levels."""
    stack: list[list] = []
    roots = 0
    for i, h in enumerate(headings):
        h["seq"], h["sec_start"], h["sec_end"] = i, h["line"], total
        while stack and stack[-1][0] >= h["level"]:
            headings[stack.pop()[3]]["sec_end"] = h["line"] - 1
        if stack:
            stack[-1][2] += 1
            h["address"], h["parent_seq"] = f"{stack[-1][1]}.{stack[-1][2]}", stack[-1][3]
        else:
            roots += 1
            h["address"], h["parent_seq"] = str(roots), None
        stack.append([h["level"], h["address"], 0, i])


def _inlines(note: Note, content: str, block: Block, cell: bool, names: dict, emphasis: bool, span, line_of) -> None:
    """The inlines of a leaf; in a table's cell those alone that don't depend on exact places."""
    pieces = block.pieces
    text = "\n".join(content[a:b] for a, b in pieces)
    begins, at = [], 0
    for a, b in pieces:
        begins.append(at)
        at += b - a + 1

    def place(x: int) -> int:
        k = bisect.bisect_right(begins, x) - 1
        return pieces[k][0] + x - begins[k]

    for x in inlines(text, names, emphasis):
        if cell and x.kind not in ("Wikilink", "Emph", "Strong"):
            continue
        a, b = place(x.start), place(x.end - 1) + 1
        row = {"type": x.kind, "span": span(a, b), "start_line": line_of(a), **x.more, "in_cell": cell}
        if "inner" in x.more:
            i, j = x.more["inner"]
            row["inner"] = span(place(i), place(j))
        if x.kind in ("Emph", "Strong"):
            row["before"], row["after"], row["after_next"] = content[max(0, a - 1) : a] or None, content[b : b + 1] or None, content[b + 1 : b + 2] or None
        note.inlines.append(row)


def _regions(note: Note, content: str, blocks: list, starts: list[int], span, line_of) -> None:
    """Anchors pair per label, the last opened first; those without a partner are left over.  Code has no anchors."""
    mask = [(b.start, b.end) for b, _, _ in blocks if b.type == "CodeBlock" or (b.type == "HtmlBlock" and b.last > b.first and content.startswith("<!--", b.start))]
    inert = sorted((span(a, b)["start"], span(a, b)["end"]) for a, b in mask)
    inert += [(x["span"]["start"], x["span"]["end"]) for x in note.inlines if x["type"] == "CodeSpan"]
    inert.sort()
    begins, ends, most = [a for a, _ in inert], [], 0
    for _, b in inert:
        most = max(most, b)
        ends.append(most)
    open_by: dict[str, list[dict]] = {}
    for m in REGION.finditer(content):
        place, label = span(m.start(), m.end()), m[2]
        k = bisect.bisect_right(begins, place["start"]) - 1
        if (k >= 0 and place["start"] < ends[k]) or "\n" in m[0] or "\r" in m[0]:
            continue
        line = line_of(m.start())
        if not m[1]:
            open_by.setdefault(label, []).append({"label": label, "info": m[3] or None, "start": place["start"], "body_start": place["end"], "start_line": line})
        elif open_by.get(label):
            o = open_by[label].pop()
            note.regions.append({"label": label, "info": o["info"], "span": {"start": o["start"], "end": place["end"]}, "body_span": {"start": o["body_start"], "end": place["start"]}, "start_line": o["start_line"], "end_line": line})
        else:
            note.dangling.append({"kind": "close", "label": label, "line": line})
    for stack in open_by.values():
        note.dangling += [{"kind": "open", "label": o["label"], "line": o["start_line"]} for o in stack]
    note.regions.sort(key=lambda r: r["span"]["start"])
    note.dangling.sort(key=lambda d: d["line"])

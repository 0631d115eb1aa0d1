"""The block structure of a note: containers to any depth, line by line, with lazy continuation.

A stack holds the open blocks.  A line first meets the open containers from the outside in; what is left of it may open
new ones, and the rest goes to the innermost block.  Columns count tabs as up to four blanks, also where a container
takes only a part of one.  Nothing here recurses, so depth has no limit.
"""

from __future__ import annotations

import re

FENCE = re.compile(r"(`{3,})([^`]*)\Z|(~{3,})(.*)\Z", re.S)
ATX = re.compile(r"(#{1,6})(?:[ \t]+|\Z)")
SETEXT = re.compile(r"(?:=+|-+)[ \t]*\Z")
BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
MARKER = re.compile(r"([-*+])(?=[ \t]|\Z)|(\d{1,9})([.)])(?=[ \t]|\Z)")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
TASK = re.compile(r"\[([ xX])\][ \t]")
_TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
DEFINITION = re.compile(rf"\[((?:[^\[\]\\]|\\.){{1,999}})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)({_TITLE}))?[ \t]*(?:\n|\Z)", re.S)
#: Names that begin an HTML block whose end is a blank line.
HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|"
    "legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
#: What begins an HTML block, what ends it (None: a blank line), and whether it may interrupt a paragraph.
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|\Z)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(rf"</?(?:{HTML_NAMES})(?:[ \t]|/?>|\Z)", re.I), None, True),
    (re.compile(rf"(?:{_TAG})[ \t]*\Z"), None, False),
]
CONTAINERS = ("Document", "BlockQuote", "List", "ListItem")


class Block:
    """A block; places are characters of the whole text, lines count from 0, ``pieces`` are the text's parts of a leaf."""

    __slots__ = ("type", "start", "end", "first", "last", "children", "pieces", "data")

    def __init__(self, kind: str, start: int, end: int, line: int, **data):
        self.type, self.start, self.end, self.first, self.last = kind, start, end, line, line
        self.children: list[Block] = []
        self.pieces: list[tuple[int, int]] = []
        self.data = data


class Reader:
    """Reads the lines of a text; ``root`` has the blocks, ``names`` the targets of link definitions."""

    def __init__(self, text: str, lines: list[str], starts: list[int], first: int = 0):
        self.text, self.names = text, {}
        self.root = Block("Document", 0, 0, 0)
        self.stack = [self.root]
        for self.number in range(first, len(lines)):
            self.line, self.base = lines[self.number], starts[self.number]
            self._line()
        self._close_to(1)

    # Places in a line.

    def _look(self) -> None:
        """The next sign that isn't white space, and how many columns it is indented from here."""
        at, column, line = self.pos, self.column, self.line
        while at < len(line):
            if line[at] == " ":
                column += 1
            elif line[at] == "\t":
                column += 4 - column % 4
            else:
                break
            at += 1
        self.next, self.indent, self.blank = at, column - self.column, at == len(line)

    def _skip(self, columns: int) -> None:
        """Past so many columns of white space, and no further than these."""
        while columns > 0 and self.pos < len(self.line) and self.line[self.pos] in " \t":
            width = 4 - self.column % 4 if self.line[self.pos] == "\t" else 1
            if width > columns:
                self.column += columns
                return
            self.pos, self.column, columns = self.pos + 1, self.column + width, columns - width

    def _to_next(self, signs: int = 0) -> None:
        """Past the white space, and so many signs."""
        self.column += self.indent + signs
        self.pos = self.next + signs

    # The stack of open blocks.

    def _add(self, kind: str, start: int, **data) -> Block:
        stack = self.stack
        while (tip := stack[-1]).type not in CONTAINERS or (tip.type == "List" and kind != "ListItem"):
            self._close_to(len(stack) - 1)
        block = Block(kind, self.base + start, self.base + len(self.line), self.number, **data)
        tip.children.append(block)
        stack.append(block)
        return block

    def _close_to(self, n: int) -> None:
        stack = self.stack
        while len(stack) > n:
            block = stack.pop()
            parent = stack[-1] if stack else None
            if block.type == "Paragraph" and parent is not None:
                if not block.pieces or self.text.startswith("[", block.pieces[0][0]):
                    self._definitions(block)
                    if not block.pieces:
                        parent.children.remove(block)
                        continue
            elif block.type == "CodeBlock" and not block.data["fenced"]:
                while block.pieces and not self.text[slice(*block.pieces[-1])].strip():
                    block.pieces.pop()
            elif block.type == "ListItem" and block.children and block.children[0].type == "Paragraph":
                if m := TASK.match(self.text, *block.children[0].pieces[0]):
                    block.data["task"] = m[1] != " "
            elif block.type == "List":
                apart = [(a, b) for x in [block, *block.children] for a, b in zip(x.children, x.children[1:], strict=False)]
                block.data["tight"] = all(b.first - a.last <= 1 for a, b in apart)
            if parent is not None and block.end > parent.end:
                parent.end, parent.last = block.end, max(parent.last, block.last)

    def _grow(self, block: Block) -> None:
        block.end, block.last = self.base + len(self.line), self.number

    def _definitions(self, block: Block) -> None:
        """Takes the link definitions from the start of a paragraph."""
        while block.pieces and self.text.startswith("[", block.pieces[0][0]):
            joined = "\n".join(self.text[a:b] for a, b in block.pieces)
            m = DEFINITION.match(joined)
            if not m or not m[1].strip():
                return
            target = m[2][1:-1] if m[2].startswith("<") else m[2]
            self.names.setdefault(label(m[1]), (target, m[3][1:-1] if m[3] else None))
            used = joined.count("\n", 0, m.end()) if m.end() < len(joined) or joined[m.end() - 1] == "\n" else len(block.pieces)
            block.pieces = block.pieces[used:]
            if block.pieces:
                block.start, block.first = block.pieces[0][0], block.first + used

    # One line.

    def _line(self) -> None:
        line, stack = self.line, self.stack
        depth = len(stack)
        if depth == 1 or (depth == 2 and stack[1].type == "Paragraph"):
            # The commonest lines outside of containers: an empty one, text and headings.
            if not line:
                self._close_to(1)
                return
            if line[0].isalpha():
                # A line that begins with a letter opens no block and goes on with an open paragraph.
                self._text(stack[1] if depth == 2 else self._add("Paragraph", 0), 0)
                return
            if line[0] == "#" and (m := ATX.match(line)):
                self._heading(m, 0)
                return
        elif depth == 2 and stack[1].type == "CodeBlock" and stack[1].data["fenced"] and line[:1] not in (" ", "\t", stack[1].data["sign"]):
            self.pos = 0
            self._verbatim(stack[1])
            return
        self.pos = self.column = 0
        matched = 1
        for block in stack[1:]:
            self._look()
            if not self._goes_on(block):
                break
            if self.pos < 0:
                return
            matched += 1
        leaf = stack[-1] if matched == len(stack) else None
        if leaf is not None and leaf.type in ("CodeBlock", "HtmlBlock"):
            self._verbatim(leaf)
            return
        lazy = matched < len(stack) and stack[-1].type == "Paragraph"
        opened = False
        while True:
            self._look()
            begun = self._begins(stack[matched - 1] if not opened else stack[-1], matched if not opened else len(stack), lazy and not opened)
            if not begun:
                break
            if self.pos < 0:
                return
            opened = True
        tip = stack[-1]
        if lazy and not opened and not self.blank:
            self._text(tip, self.next)
            # The containers of a lazy line go on with it.
            return
        if not opened:
            self._close_to(matched)
        tip = stack[-1]
        if self.blank:
            return
        if tip.type == "Table":
            self._row(tip)
        elif tip.type == "Paragraph":
            self._text(tip, self.next)
        else:
            self._text(self._add("Paragraph", self.next), self.next)

    def _text(self, block: Block, at: int) -> None:
        block.pieces.append((self.base + at, self.base + len(self.line)))
        self._grow(block)

    def _verbatim(self, block: Block) -> None:
        block.pieces.append((self.base + self.pos, self.base + len(self.line)))
        if block.type == "HtmlBlock" or block.data["fenced"] or self.line[self.pos :].strip():
            self._grow(block)
        if block.type == "HtmlBlock" and block.data["stop"] is not None and block.data["stop"].search(self.line, self.pos):
            self._close_to(len(self.stack) - 1)

    def _goes_on(self, block: Block) -> bool:
        """Whether an open block goes on in this line; ``pos`` is -1 if the line is done with it."""
        kind = block.type
        if kind == "BlockQuote":
            if self.indent > 3 or self.blank or self.line[self.next] != ">":
                return False
            self._to_next(1)
            self._skip(1)
            self._grow(block)
        elif kind == "ListItem":
            if self.blank:
                if not block.children:
                    return False
                self._to_next()
            elif self.indent >= block.data["content"]:
                self._skip(block.data["content"])
            else:
                return False
        elif kind == "CodeBlock" and block.data["fenced"]:
            sign, n = block.data["sign"], block.data["length"]
            rest = self.line[self.next :]
            if self.indent <= 3 and rest.startswith(sign * n) and not rest.strip(" \t").strip(sign):
                block.data["closed"] = self.base
                self._grow(block)
                self._close_to(self.stack.index(block))
                self.pos = -1
            else:
                self._skip(min(self.indent, block.data["indent"]))
        elif kind == "CodeBlock":
            if self.indent >= 4:
                self._skip(4)
            elif self.blank:
                self._to_next()
            else:
                return False
        elif kind in ("HtmlBlock", "Paragraph", "Table"):
            return not self.blank or (kind == "HtmlBlock" and block.data["stop"] is not None)
        return True

    def _begins(self, container: Block, depth: int, lazy: bool) -> bool:
        """Opens the block that begins here, if any; ``pos`` is -1 if it takes the whole line."""
        if self.blank:
            return False
        line, at = self.line, self.next
        paragraph = container if container.type == "Paragraph" else None
        if self.indent >= 4:
            if paragraph is not None or lazy or container.type == "Table":
                return False
            self._close_to(depth)
            self._skip(4)
            self._verbatim(self._add("CodeBlock", self.pos, fenced=False))
            self.pos = -1
            return True
        sign = line[at]
        if sign == ">":
            self._close_to(depth)
            self._add("BlockQuote", at)
            self._to_next(1)
            self._skip(1)
            return True
        if sign == "#" and (m := ATX.match(line, at)):
            self._close_to(depth)
            self._heading(m, at)
            self.pos = -1
            return True
        if sign in "`~" and (m := FENCE.match(line, at)):
            self._close_to(depth)
            run, info = m[1] or m[3], m[2] if m[1] else m[4]
            self._add("CodeBlock", at, fenced=True, sign=run[0], length=len(run), indent=self.indent, info=info.strip(" \t"), body=self.base + len(line))
            self.pos = -1
            return True
        if sign == "<":
            for begin, stop, interrupts in HTML:
                if begin.match(line, at) and (interrupts or (paragraph is None and not lazy)):
                    self._close_to(depth)
                    self._verbatim(self._add("HtmlBlock", at, stop=stop))
                    self.pos = -1
                    return True
        if paragraph is not None and sign in "=-" and SETEXT.match(line, at):
            self._definitions(paragraph)
            if paragraph.pieces:
                paragraph.type, paragraph.data = "Heading", {"level": 1 if sign == "=" else 2, "setext": True}
                self._grow(paragraph)
                self._close_to(len(self.stack) - 1)
                self.pos = -1
                return True
        if sign in "*-_" and BREAK.match(line, at):
            self._close_to(depth)
            self._add("ThematicBreak", at)
            self._close_to(len(self.stack) - 1)
            self.pos = -1
            return True
        if (m := MARKER.match(line, at)) and not (paragraph is not None and (not line[m.end() :].strip() or (m[2] and int(m[2]) != 1))):
            self._close_to(depth)
            self._item(m)
            return True
        if paragraph is not None and sign in "|:-" and DELIMITERS.match(line, at) and self._table(paragraph):
            self.pos = -1
            return True
        return False

    def _heading(self, m: re.Match, at: int) -> None:
        text = self.line[m.end() :].rstrip(" \t")
        inner = "" if not text.strip("#") else re.sub(r"[ \t]+#+\Z", "", text) if text[-1] == "#" else text
        block = self._add("Heading", at, level=len(m[1]), setext=False)
        block.pieces.append((self.base + m.end(), self.base + m.end() + len(inner)))
        self._close_to(len(self.stack) - 1)

    def _item(self, m: re.Match) -> None:
        kind = m[1] or m[3]
        indent, at = self.indent, self.next
        self._to_next(m.end() - m.start())
        width = m.end() - m.start()
        self._look()
        spaces = 1 if self.blank or self.indent >= 5 else self.indent
        if self.stack[-1].type != "List" or self.stack[-1].data["marker"] != kind:
            self._add("List", at, marker=kind, ordered=m[1] is None, number=int(m[2]) if m[2] else None, tight=True)
        self._add("ListItem", at, content=indent + width + spaces, task=None)
        if self.blank:
            self._to_next()
        else:
            self._skip(spaces)

    def _table(self, paragraph: Block) -> bool:
        """Makes a table of the paragraph's last line, if it has as many cells as this line has delimiters."""
        a, b = paragraph.pieces[-1]
        head, columns = cells(self.text, a, b), len(cells(self.line, self.next, len(self.line)))
        if len(head) != columns or ("|" not in self.text[a:b] and columns > 1) or "|" not in self.text[a:b] + self.line:
            return False
        rest = len(paragraph.pieces) > 1
        if rest:
            paragraph.pieces.pop()
            paragraph.last -= 1
            paragraph.end = paragraph.pieces[-1][1]
            self._close_to(len(self.stack) - 1)
        else:
            self.stack.pop()
            self.stack[-1].children.remove(paragraph)
        table = Block("Table", a, self.base + len(self.line), self.number - 1, columns=columns)
        table.last = self.number
        self.stack[-1].children.append(table)
        self.stack.append(table)
        self._cells(table, a, b, self.number - 1, True)
        return True

    def _row(self, table: Block) -> None:
        self._cells(table, self.base + self.next, self.base + len(self.line), self.number, False)
        self._grow(table)

    def _cells(self, table: Block, a: int, b: int, number: int, header: bool) -> None:
        row = Block("TableRow", a, a + len(self.text[a:b].rstrip()), number, header=header)
        for x, y in cells(self.text, a, b)[: table.data["columns"]]:
            cell = Block("TableCell", x, y, number)
            cell.pieces.append((x, y))
            row.children.append(cell)
        table.children.append(row)


def label(text: str) -> str:
    """The name of a link definition, as names are compared."""
    return " ".join(text.split()).casefold()


def cells(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The places of the cells of a table's row, without the white space around them."""
    while b > a and text[b - 1] in " \t":
        b -= 1
    while a < b and text[a] in " \t":
        a += 1
    if a < b and text[a] == "|":
        a += 1
    bars, at = [], a
    while (at := text.find("|", at, b)) >= 0:
        back = at
        while back > a and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            bars.append(at)
        at += 1
    if not bars or bars[-1] != b - 1:
        bars.append(b)
    out = []
    for end in bars:
        x, y = a, end
        while x < y and text[x] in " \t":
            x += 1
        while y > x and text[y - 1] in " \t":
            y -= 1
        out.append((x, y))
        a = end + 1
    return out

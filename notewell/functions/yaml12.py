"""A reader for note frontmatter: the YAML 1.2 core schema over block and flow collections and scalars.

Dates stay strings; ``yes`` and ``012`` are a string and the number 12, as the core schema has it.
"""

from __future__ import annotations

import re
from functools import lru_cache

_INT = re.compile(r"[-+]?[0-9]+\Z")
_HEX = re.compile(r"0x[0-9a-fA-F]+\Z|0o[0-7]+\Z")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?\Z")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`{}\[\],?:-][^#]*?|[-?:][^\s#][^#]*?|[^\s'"#][^:#]*?)\s*:(?=\s|\Z)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "0": "\0", "e": "\x1b", " ": " ", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


#: Lines that most frontmatter is made of: a key with a plain scalar, a text in quotes, or a list of plain scalars.
_PLAIN = re.compile(r"""([A-Za-z_][\w-]*):[ ]+(?:([\w./+~][^#:"'\[\]{}\t]*)|"([^"\\]*)"|\[([^\[\]{}"'#:&*!|>%@`\t]*)\])[ ]*\Z""")


_ITEM = r"""[ ]*+(?:[^\s\[\]{}"'#:&*!|>%@`,]++(?:[ ]++[^\s\[\]{}"'#:&*!|>%@`,]++)*+|"[^"\\\n\t#]*+")[ ]*+"""
#: Blocks that hold nothing but such lines, lists of which some items are in quotes, keys without a value, and keys with a list of texts in quotes below them.
_ALL_PLAIN = re.compile(rf"""(?:\n[A-Za-z][\w-]*+:(?:[ ]++(?:[\w./+~][^#:"'\[\]{{}}\t\n]*+|"[^"\\\n]*+"[ ]*+|\[{_ITEM}(?:,{_ITEM})*+\][ ]*+)|[ ]*+(?:\n[ ][ ]-[ ]"[^"\\\t\n]*+")*+)(?=\n|\Z))++\Z""")
_PLAIN_KEYS = re.compile(r"\n([A-Za-z][\w-]*+):")


class YamlError(ValueError):
    pass


def scalar(text: str):
    """The value of a plain scalar."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if _INT.match(text):
        return int(text)
    if _HEX.match(text):
        return int(text, 0)
    if _FLOAT.match(text):
        return float(text)
    if text in (".nan", ".NaN", ".NAN"):
        return float("nan")
    if text.lstrip("+-") in (".inf", ".Inf", ".INF"):
        return float("-inf" if text[0] == "-" else "inf")
    return text


def _unquote_double(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise YamlError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text, flags=re.S)


class _Flow:
    """Flow collections and quoted scalars within one stretch of text."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def value(self, stops: str = ""):
        self.blanks()
        c = self.peek()
        if c == "[":
            return self.items("]", self.value)
        if c == "{":
            return dict(self.items("}", self.pair))
        if c == '"':
            return self.double()
        if c == "'":
            return self.single()
        begin = self.at
        while self.at < len(self.text) and not (self.text[self.at] in stops or (self.text[self.at] == ":" and "}" in stops and self.text[self.at + 1 : self.at + 2] in (" ", ""))):
            self.at += 1
        return scalar(self.text[begin : self.at].strip())

    def items(self, end: str, one) -> list:
        self.at += 1
        out = []
        while True:
            self.blanks()
            if not self.peek():
                raise YamlError("a flow collection isn't closed")
            if self.peek() == end:
                self.at += 1
                return out
            out.append(one(",]" if end == "]" else ",}"))
            self.blanks()
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != end:
                raise YamlError("a comma is missing in a flow collection")

    def pair(self, stops: str) -> tuple:
        key = self.value(stops)
        self.blanks()
        if self.peek() != ":":
            return display(key), None
        self.at += 1
        return display(key), self.value(stops)

    def double(self) -> str:
        end = self.at + 1
        while end < len(self.text) and self.text[end] != '"':
            end += 2 if self.text[end] == "\\" else 1
        if end >= len(self.text):
            raise YamlError("a double quote isn't closed")
        body, self.at = self.text[self.at + 1 : end], end + 1
        return _unquote_double(body)

    def single(self) -> str:
        m = re.compile(r"'((?:[^']|'')*)'").match(self.text, self.at)
        if not m:
            raise YamlError("a single quote isn't closed")
        self.at = m.end()
        return m[1].replace("''", "'")


@lru_cache(1 << 13)
def _flow(text: str) -> tuple:
    """The value that a text begins with, and whether nothing follows it.  Equal texts share the value, so it isn't changed."""
    flow = _Flow(text)
    value = flow.value()
    flow.blanks()
    return value, not flow.peek()


def _flow_of(text: str) -> tuple:
    return _flow(text) if len(text) <= 200 else _flow.__wrapped__(text)


def _strip_comment(text: str) -> str:
    if "#" not in text:
        return text.rstrip()
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


@lru_cache(1 << 14)
def _plain_line(line: str) -> tuple | None:
    """The key and the value of a line that is complete in itself, if it is one; most recur from note to note."""
    m = _PLAIN.match(line)
    if not m:
        return None
    key, plain, quoted, items = m.groups()
    if items is None:
        return key, scalar(plain.strip()) if plain is not None else quoted
    items = items.split(",")
    # An empty item is an error or a null, which the full reading tells apart.
    return (key, [scalar(x.strip()) for x in items]) if all(x.strip() for x in items) else None


class _Block:
    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0

    def skip(self) -> None:
        if self.at < len(self.lines) and self.lines[self.at][:1].isalpha():
            return
        while self.at < len(self.lines) and not _strip_comment(self.lines[self.at]).strip():
            self.at += 1

    def indent(self) -> int:
        line = self.lines[self.at]
        return len(line) - len(line.lstrip(" "))

    def node(self, least: int):
        self.skip()
        if self.at >= len(self.lines) or self.indent() < least:
            return None
        if "\t" in self.lines[self.at][: self.indent() + 1]:
            raise YamlError("a tab can't indent")
        body = self.lines[self.at].strip()
        if body == "-" or body.startswith("- "):
            return self.sequence(self.indent())
        if _KEY.match(body):
            return self.mapping(self.indent())
        return self.inline(least)

    def inline(self, least: int, text: str | None = None):
        """A scalar or flow value that begins with ``text`` on the line before, or on this line."""
        if text is None:
            text = self.lines[self.at].strip()
            self.at += 1
        if text[:1] in "|>" and re.match(r"[|>][-+0-9]*\s*(#.*)?\Z", text):
            return self.literal(least, text)
        text = _strip_comment(text)
        # Continuation lines of quotes, flows and plain scalars.
        while self.at < len(self.lines):
            opens = text[:1] in "[{" and not self.complete(text) or text[:1] in "\"'" and not self.complete(text)
            line = self.lines[self.at]
            more = text[:1] not in "[{\"'" and text and line.strip() and self.indent() >= max(1, least) and not _KEY.match(line.strip()) and not line.strip().startswith(("- ", "#"))
            if not (opens or more):
                break
            text += " " + _strip_comment(line.strip())
            self.at += 1
        if text[:1] in "[{\"'":
            value, whole = _flow_of(text)
            if not whole:
                raise YamlError("text after the end of a value")
            return value
        if text[:1] in "&*!%@`" and text:
            raise YamlError(f"a value can't begin with {text[0]}")
        if re.search(r":(\s|\Z)", text):
            raise YamlError("a mapping can't stand within a plain value")
        return scalar(text.strip())

    @staticmethod
    def complete(text: str) -> bool:
        try:
            _flow_of(text)
        except YamlError:
            return False
        return True

    def literal(self, least: int, head: str) -> str:
        out: list[str] = []
        own = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                if self.indent() < max(1, least) or own is not None and self.indent() < own:
                    break
                own = self.indent() if own is None else own
            out.append(line[own or 0 :])
            self.at += 1
        text = "\n".join(out).rstrip("\n") if head[0] == "|" else re.sub(r"(?<=\S)\n(?=\S)", " ", "\n".join(out).rstrip("\n"))
        return text if "-" in head else text + "\n" if text else text

    def sequence(self, indent: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at >= len(self.lines) or self.indent() != indent or not re.match(r"-(\s|\Z)", self.lines[self.at].strip()):
                if self.at < len(self.lines) and self.indent() > indent:
                    raise YamlError("bad indentation in a sequence")
                return out
            rest = self.lines[self.at].strip()[1:]
            if not _strip_comment(rest).strip():
                self.at += 1
                out.append(self.node(indent + 1))
            elif _KEY.match(rest.strip()) or rest.strip().startswith("- "):
                inner = indent + 1 + len(rest) - len(rest.lstrip())
                self.lines[self.at] = " " * inner + rest.strip()
                out.append(self.node(inner))
            else:
                self.at += 1
                out.append(self.inline(indent + 1, rest.strip()))

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while True:
            if indent or self.at >= len(self.lines) or not self.lines[self.at][:1].isalpha():
                self.skip()
                if self.at >= len(self.lines) or self.indent() < indent:
                    return out
                if self.indent() > indent:
                    raise YamlError("bad indentation in a mapping")
            body = self.lines[self.at].strip()
            found = _plain_line(body) if len(body) <= 200 else _plain_line.__wrapped__(body)
            if found is not None and found[0] not in out and not (self.at + 1 < len(self.lines) and self.lines[self.at + 1][:1] in (" ", "\t", "")):
                # A list is the reader's own, whatever becomes of it.
                out[found[0]] = list(found[1]) if isinstance(found[1], list) else found[1]
                self.at += 1
                continue
            m = _KEY.match(body)
            if not m:
                raise YamlError(f"no key in {body[:40]!r}")
            key = display(_Flow(m[1]).value()) if m[1][0] in "\"'" else m[1].strip()
            if key in out:
                raise YamlError(f"the key {key!r} stands twice")
            rest = body[m.end() :].strip()
            self.at += 1
            if _strip_comment(rest):
                out[key] = self.inline(indent + 1, rest)
            else:
                self.skip()
                # A sequence may stand at the indentation of its key.
                same = self.at < len(self.lines) and self.indent() == indent and re.match(r"-(\s|\Z)", self.lines[self.at].strip())
                out[key] = self.sequence(indent) if same else self.node(indent + 1)


def load(text: str) -> dict:
    """The mapping that ``text`` holds; empty text is an empty one."""
    block = _Block(text.split("\n"))
    block.skip()
    if block.at >= len(block.lines):
        return {}
    value = block.node(0)
    block.skip()
    if block.at < len(block.lines):
        raise YamlError("text after the end of the mapping")
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise YamlError("the frontmatter is no mapping")
    return value


def picked(text: str, keys: tuple[str, ...] | None) -> dict | None:
    """The values of some keys, or of all in their order, of a mapping whose lines all are plain ones; None if only ``load`` can tell.

    All lines are looked at, those of other keys only for their form.
    """
    text = "\n" + text
    if "\r" in text or not _ALL_PLAIN.match(text):
        return None
    found = _PLAIN_KEYS.findall(text)
    if len(set(found)) < len(found):
        return None
    out = {}
    for key in sorted(found) if keys is None else keys:
        at = text.find(f"\n{key}:")
        if at < 0:
            continue
        end = text.find("\n", at + 1)
        line = (text[at + 1 :] if end < 0 else text[at + 1 : end]).strip()
        if len(line) > len(key) + 1:
            plain = _plain_line(line) if len(line) <= 200 else _plain_line.__wrapped__(line)
            value = plain[1] if plain is not None else _flow_of(line[len(key) + 1 :].strip())[0]
            out[key] = list(value) if isinstance(value, list) else value
            continue
        items = None
        while text.startswith("\n  - ", end) and end >= 0:
            at, end = end, text.find("\n", end + 1)
            items = [*(items or ()), (text[at + 5 :] if end < 0 else text[at + 5 : end])[1:-1]]
        out[key] = items
    return out


def number_text(value: float) -> str:
    """Shortest digits that give the number, never with an exponent."""
    if value != value or value in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[repr(value)]
    text = repr(value)
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text


def display(value) -> str:
    """How a value is shown and compared: null is empty, lists and mappings are joined by commas."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, list):
        return ", ".join(map(display, value))
    if isinstance(value, dict):
        return ", ".join(f"{k}: {display(v)}" for k, v in value.items())
    return str(value)

"""The inlines of a text: code spans, links, images, wikilinks, autolinks and emphasis, nested in each other.

One pass from left to right keeps a stack of brackets and a list of delimiter runs.  A closing bracket looks for the
target behind it, or for a definition by its text; emphasis is matched by the flanking rules when a link closes and at
the end of the text.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from notewell.functions.blocks import _TAG, label

WIKI = re.compile(r"\[\[([^\[\]\n|]+?)(?:\\?\|([^\[\]\n|]*))?\]\]")
EMBED = re.compile(r"!\[\[((?:(?!\[\[|\]\])[^\n])*)\]\]")
SPECIAL = re.compile(r"[\\`*_~\[\]!<]|(?:https?|ftp)://|www\.|@")
PLAIN = re.compile(r"[\\`\[\]!<]|(?:https?|ftp)://|www\.|@")
CODE = re.compile(r"`+")
ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")
RAW = re.compile(rf"{_TAG}|<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
TAIL = re.compile(r"\(\s*(?:(<(?:[^<>\n\\]|\\.)*>)|((?:[^\s()\\<]|\\.)(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*|))(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
NAME = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
BARE = re.compile(r"[^\s<]*")
ADDRESS = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


@dataclass(slots=True)
class Inline:
    kind: str
    start: int
    end: int
    more: dict


@dataclass(slots=True)
class Run:
    """A run of delimiters: what is left of it, and whether it can begin and end emphasis."""

    sign: str
    start: int
    end: int
    opens: bool
    closes: bool
    whole: int


@lru_cache(4096)
def _kind(sign: str) -> int:
    """0 white space, 1 punctuation or symbol, 2 anything else."""
    return 0 if sign.isspace() else 1 if unicodedata.category(sign)[0] in "PS" else 2


def plain(text: str) -> str:
    """A target or title without its escapes and entities."""
    return html.unescape(ESCAPED.sub(r"\1", text)) if "\\" in text or "&" in text else text


def wikilink(target: str, alias: str | None, embed: bool) -> dict:
    page, _, rest = target.partition("#")
    block = rest.startswith("^")
    return {"target": target, "alias": alias, "embed": embed, "page": page, "heading": rest if rest and not block else None, "block": rest[1:] if block else None}


def inlines(text: str, names: dict[str, tuple[str, str | None]], emphasis: bool = True) -> list[Inline]:
    """The inlines of ``text`` in the order in which they begin, outer ones first."""
    out: list[Inline] = []
    runs: list[Run] = []
    brackets: list[list] = []
    ticks: dict[int, list[int]] | None = None
    special = SPECIAL if emphasis else PLAIN
    at = 0
    while m := special.search(text, at):
        sign, i = m[0], m.start()
        at = i + 1
        if sign == "\\":
            if at < len(text) and ESCAPED.match(text, i):
                at += 1
        elif sign == "`":
            if ticks is None:
                ticks = {}
                for run in CODE.finditer(text):
                    ticks.setdefault(len(run[0]), []).append(run.start())
            at = CODE.match(text, i).end()
            same = ticks.get(at - i, [])
            k = bisect.bisect_left(same, at)
            if k < len(same):
                out.append(Inline("CodeSpan", i, same[k] + at - i, {}))
                at = same[k] + at - i
        elif sign in "*_~":
            while at < len(text) and text[at] == sign:
                at += 1
            before, after = _kind(text[i - 1]) if i else 0, _kind(text[at]) if at < len(text) else 0
            left = after == 2 or (after == 1 and before < 2)
            right = before == 2 or (before == 1 and after < 2)
            opens, closes = (left and (not right or before == 1), right and (not left or after == 1)) if sign == "_" else (left, right)
            if sign != "~" or at - i <= 2:
                runs.append(Run(sign, i, at, opens, closes, at - i))
        elif sign == "!":
            if text.startswith("[[", at):
                if e := EMBED.match(text, i):
                    target, bar, alias = e[1].partition("|")
                    out.append(Inline("Wikilink", i, e.end(), wikilink(target.rstrip("\\").strip(), alias.strip() if bar else None, True)))
                    at = e.end()
            elif text.startswith("[", at):
                brackets.append([i, at + 1, True, True, len(runs), len(out)])
                at += 1
        elif sign == "[":
            if text.startswith("[", at) and (w := WIKI.match(text, i)) and w[1].strip():
                out.append(Inline("Wikilink", i, w.end(), wikilink(w[1].strip(), w[2].strip() if w[2] is not None else None, False)))
                at = w.end()
            else:
                brackets.append([i, at, False, True, len(runs), len(out)])
        elif sign == "]":
            if brackets:
                at = _closed(text, i, brackets, runs, out, names)
        elif sign == "<":
            if a := ANGLE.match(text, i):
                out.append(Inline("Autolink", i, a.end(), {"url": a[1]}))
                at = a.end()
            elif a := RAW.match(text, i):
                at = a.end()
        elif sign == "@":
            at = _address(text, i, out) if not brackets else at
        else:
            at = m.end()
            if not brackets and (i == 0 or not (text[i - 1].isalnum() if sign != "www." else text[i - 1] not in "*_~(" and not text[i - 1].isspace())):
                end = _trimmed(text, i, BARE.match(text, at).end())
                if end > at:
                    out.append(Inline("Autolink", i, end, {"url": text[i:end]}))
                    at = end
    _emphasis(runs, 0, out)
    # An address within another link or in code is none of its own.
    out.sort(key=lambda x: (x.start, -x.end))
    return out


def _closed(text: str, i: int, brackets: list[list], runs: list[Run], out: list[Inline], names: dict) -> int:
    """What the bracket at ``i`` closes; returns where to go on."""
    start, inner, image, active, n_runs, _ = brackets.pop()
    if not active:
        return i + 1
    target = title = None
    end = i + 1
    if tail := TAIL.match(text, i + 1):
        target, title, end = (tail[1][1:-1] if tail[1] else tail[2]), (tail[3][1:-1] if tail[3] else None), tail.end()
    else:
        name = NAME.match(text, i + 1)
        asked = name[1] if name and name[1].strip() else text[inner:i]
        found = names.get(label(asked)) if "[" not in asked.replace("\\[", "") else None
        if found is None and name and name[1].strip():
            return i + 1
        if found is None:
            return i + 1
        target, title = found
        end = name.end() if name else end
    out.append(Inline("Image" if image else "Link", start, end, {"url": plain(target), "title": plain(title) if title else None, "inner": (inner, i)}))
    _emphasis(runs, n_runs, out)
    if not image:
        # Links hold no links.
        for b in brackets:
            if not b[2]:
                b[3] = False
    return end


def _trimmed(text: str, a: int, b: int) -> int:
    """The end of a bare address without the punctuation that follows it."""
    while b > a:
        if text[b - 1] in "?!.,:*_~'\"]":
            b -= 1
        elif text[b - 1] == ")" and text.count(")", a, b) > text.count("(", a, b):
            b -= 1
        elif text[b - 1] == ";" and (m := re.search(r"&[A-Za-z0-9]+;\Z", text[a:b])):
            b = a + m.start()
        else:
            break
    return b


def _address(text: str, i: int, out: list[Inline]) -> int:
    """A bare mail address around the sign at ``i``."""
    a = i
    while a and (text[a - 1].isalnum() or text[a - 1] in ".+-_") and text[a - 1].isascii():
        a -= 1
    m = ADDRESS.match(text, i + 1)
    if a == i or not m or (out and out[-1].end > a):
        return i + 1
    end = m.end()
    if text[end - 1] in "-_":
        return i + 1
    out.append(Inline("Autolink", a, end, {"url": "mailto:" + text[a:end]}))
    return end


def _emphasis(runs: list[Run], bottom: int, out: list[Inline]) -> None:
    """Matches the runs from ``bottom`` on, and takes them off the list."""
    openers: list[Run] = []
    searched: dict[tuple, int] = {}
    for run in runs[bottom:]:
        while run.closes and run.start < run.end:
            key = (run.sign, run.opens, run.whole % 3)
            k = len(openers) - 1
            least = min(searched.get(key, 0), len(openers))
            while k >= least:
                o = openers[k]
                # Lengths that add up to a multiple of three don't match where a run could do both.
                if o.sign == run.sign and not ((o.closes or run.opens) and (o.whole + run.whole) % 3 == 0 and (o.whole % 3 or run.whole % 3)) and (run.sign != "~" or o.end - o.start == run.end - run.start):
                    break
                k -= 1
            if k < least:
                searched[key] = len(openers)
                break
            o = openers[k]
            del openers[k + 1 :]
            used = run.end - run.start if run.sign == "~" else 2 if o.end - o.start > 1 and run.end - run.start > 1 else 1
            o.end -= used
            run.start += used
            if run.sign != "~":
                out.append(Inline("Strong" if used == 2 else "Emph", o.end, run.start, {}))
            if o.end == o.start:
                openers.pop()
        if run.opens and run.start < run.end:
            openers.append(run)
    del runs[bottom:]

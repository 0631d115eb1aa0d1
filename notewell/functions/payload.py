"""Text that must survive a rewrite: blocks, payload lanes, masks and spans."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

from notewell.functions.blocks import ATX

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def segment(text: str) -> list[str]:
    """Blocks between blank lines; a fence is one block, whatever it holds."""
    out, now, fence = [], [], None
    for line in text.split("\n"):
        m = FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence and m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
            fence = None
        if fence is None and not line.strip():
            if now:
                out.append("\n".join(now))
            now = []
        else:
            now.append(line)
    return out + (["\n".join(now)] if now else [])


def strip_fences(text: str) -> str:
    out, fence = [], None
    for line in text.split("\n"):
        m = FENCE.match(line)
        if fence is None and m:
            fence = m[1]
        elif fence is None:
            out.append(line)
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
            fence = None
    return "\n".join(out)


def _words(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def harvest(text: str) -> list[tuple[str, str, str]]:
    """(lane, markup, key) of what a text carries besides prose: links, fences, quotes, rows, images, math, citations, numbers."""
    out: list[tuple[str, str, str]] = []
    for block in segment(text):
        if m := re.match(r" {0,3}(`{3,}|~{3,})([^\n]*)\n(.*?)(?:\n {0,3}\1[`~]*\s*)?\Z", block, re.S):
            out.append(("fence", block, _words(m[3])))
    prose = strip_fences(text)
    for m in re.finditer(r"(!?)\[\[([^\[\]\n|]+)(?:\|[^\[\]\n]*)?\]\]", prose):
        if not (m[1] and re.search(r"\.(png|jpe?g|gif|svg|pdf|canvas|base|tldraw)$", m[2], re.I)):
            out.append(("wikilink", m[0], m[2].split("#")[0].strip()))
    for m in re.finditer(r"(!?)\[([^\[\]\n]*)\]\(([^()\s]+)\)", prose):
        lane = "image" if m[1] else "external" if re.match(r"[a-z][a-z0-9+.-]*:", m[3], re.I) else "internal"
        out.append((lane, m[0], unquote(m[3].split("#")[0]) if lane == "internal" else m[3]))
    quote: list[str] = []
    for line in [*prose.split("\n"), ""]:
        if re.match(r" {0,3}>", line):
            quote.append(re.sub(r"^ {0,3}> ?", "", line))
            continue
        if quote:
            out.append(("quote", "\n".join(quote), _words(" ".join(quote))))
            quote = []
        if re.match(r"\s*\|.*\|\s*$", line) and not re.fullmatch(r"[\s|:-]+", line):
            out.append(("row", line, "|".join(_words(c) for c in line.strip().strip("|").split("|"))))
    for m in re.finditer(r"\$\$(.+?)\$\$|(?<![\\$\w])\$(?=\S)([^$\n]+?)(?<=\S)\$(?![\d$])", prose, re.S):
        out.append(("math", m[0], re.sub(r"\s+", "", m[1] or m[2])))
    for m in re.finditer(r"\[@[^\]\s]+\]|\[\^[^\]\s]+\]|\([A-ZА-Я][\w-]+(?: et al\.)?,? \d{4}\)", prose):
        out.append(("citation", m[0], citation(m[0])))
    bare = re.sub(r"\[\[.*?\]\]|\]\([^)]*\)|`[^`]*`|\$[^$\n]*\$", " ", prose)
    for m in re.finditer(r"(?<![\w.,])[-+]?\d+(?:[.,]\d+)*(?:\s?%)?(?![\w])", bare):
        out.append(("number", m[0], m[0].replace(" ", "")))
    return out


def citation(text: str) -> str:
    """A citation's key: no brackets, single blanks, lower case."""
    return _words(re.sub(r"[\[\]()]", "", typography(text))).lower()


def typography(text: str) -> str:
    """Curly quotes, long dashes and special blanks as their plain signs."""
    return text.translate(str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", " ": " ", " ": " ", "…": "..."}))


def density(text: str) -> float:
    """The part of a text's words that is payload."""
    words = len(text.split())
    rest = strip_fences(text)
    rest = re.sub(r"(?m)^ {0,3}>.*$|^\s*\|.*\|\s*$", " ", rest)
    rest = re.sub(r"!?\[[^\]\n]*\]\([^)\s]*\)|`[^`\n]+`|\$\$.+?\$\$|\$[^$\n]+\$", " ", rest, flags=re.S)
    return (words - len(rest.split())) / words if words else 0.0


def mask(text: str) -> tuple[str, list[str]]:
    """Code, links and math replaced by numbered signs, and what they stand for."""
    kept: list[str] = []

    def one(m: re.Match) -> str:
        kept.append(m[0])
        return f"⟦{len(kept) - 1}⟧"

    return re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,}).*?^ {0,3}\1[`~]*\s*$|`[^`\n]+`|\[\[[^\]\n]+\]\]|\[[^\]\n]*\]\([^)\n]*\)|\$\$.+?\$\$|\$[^$\n]+\$|https?://\S+", one, text), kept


def unmask(text: str, kept: list[str]) -> str:
    return re.sub(r"⟦(\d+)⟧", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)


def fold(name: str) -> str:
    """A name without marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower()


def display_width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


BULLET, NUMBER = r"[-*+]", r"\d+[.)]"
#: The letters that number items, the first six Latin capitals and all Russian ones.
LETTERS = "ABCDEF" + "".join(map(chr, range(ord("А"), ord("Я") + 1)))
LIST_ITEM = re.compile(rf"\s*(?:{BULLET}|{NUMBER}|[{LETTERS}]\d*[.)])\s+(?P<said>\S.*)")
#: Characters from which an item can be a claim.
THIN = 12


def for_containment(text: str) -> str:
    """A text as it is looked for in another: without marks, lower case, single blanks."""
    return _words(re.sub(r"[`*_>#|\[\]()!~-]+", " ", text.lower()))


def _says_something(item: str) -> bool:
    """Whether words are left without links, images, code, rows, citations and numbers."""
    rest = mask(re.sub(r"!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]*\)|\[[@^][^\]]*\]|^\s*\|.*$", " ", item))[0]
    return bool(re.search(r"[^\W\d_]{2}", re.sub(r"⟦\d+⟧", " ", rest)))


def list_items(text: str) -> list[tuple[str, int, str, str]]:
    """(heading, depth, item, form for containment) of the list items below headings that say something."""
    out: list[tuple[str, int, str, str]] = []
    heading, fence, item = None, None, None

    def close() -> None:
        nonlocal item
        if item is not None and _says_something(item) and len(for_containment(item)) >= THIN:
            out.append((heading[1], heading[0], item, for_containment(item)))
        item = None

    for line in text.split("\n"):
        mark = FENCE.match(line)
        if fence is not None or mark:
            close()
            if fence is None:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        elif (m := ATX.match(line)) and len(m[1]) > 1 and m.end() < len(line):
            close()
            heading = len(m[1]), line[m.end() :]
        elif heading and (m := LIST_ITEM.match(line)):
            close()
            item = m["said"].rstrip()
        elif item is not None and re.match(r"\s+\S", line):
            item += " " + line.strip()
        else:
            close()
    close()
    return out

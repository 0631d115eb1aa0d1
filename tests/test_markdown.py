"""The markdown reader on small texts: what stands in what, and where."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from notewell.functions import markdown


def tree(text):
    """(depth, type, text) of each block."""
    raw = text.encode()
    return [(n["depth"], n["type"], raw[n["span"]["start"] : n["span"]["end"]].decode()) for n in markdown.structure(text).nodes]


def spans(text, *kinds):
    raw = text.encode()
    return [(x["type"], raw[x["span"]["start"] : x["span"]["end"]].decode()) for x in markdown.structure(text).inlines if not kinds or x["type"] in kinds]


def test_containers_nest_and_go_on_lazily():
    assert tree("> - a\n>   > b\nlazy\n\nout") == [
        (0, "BlockQuote", "> - a\n>   > b\nlazy"), (1, "List", "- a\n>   > b\nlazy"), (2, "ListItem", "- a\n>   > b\nlazy"), (3, "Paragraph", "a"),
        (3, "BlockQuote", "> b\nlazy"), (4, "Paragraph", "b\nlazy"), (0, "Paragraph", "out"),
    ]
    # A heading, a fence or an item ends a quote instead of going on with it.
    assert [t for _, t, _ in tree("> a\n```\nb\n```")] == ["BlockQuote", "Paragraph", "CodeBlock"]
    assert [t for _, t, _ in tree("> a\n- b")] == ["BlockQuote", "Paragraph", "List", "ListItem", "Paragraph"]


@pytest.mark.parametrize("text", [">" * 500 + " deep", "- " * 500 + "deep", "1. > " * 250 + "deep"])
def test_five_hundred_levels(text):
    found = tree(text)
    assert found[-1] == (max(d for d, _, _ in found), "Paragraph", "deep") and found[-1][0] >= 500


def test_items_own_what_is_indented():
    text = "- a\n\n      code\n\n  b\n\n    not code\n- c\n\nd\n\n1) x\n   - y\n2) z\n2. w"
    assert [(d, t, s) for d, t, s in tree(text) if t not in ("List", "ListItem")] == [
        (2, "Paragraph", "a"), (2, "CodeBlock", "code"), (2, "Paragraph", "b"), (2, "Paragraph", "not code"), (2, "Paragraph", "c"), (0, "Paragraph", "d"),
        (2, "Paragraph", "x"), (4, "Paragraph", "y"), (2, "Paragraph", "z"), (2, "Paragraph", "w"),
    ]
    lists = [n for n in markdown.structure(text).nodes if n["type"] == "List"]
    assert [(n["ordered"], n["tight"], n["marker"], n["number"]) for n in lists] == [(False, False, "-", None), (True, True, ")", 1), (False, True, "-", None), (True, True, ".", 2)]
    # A list of another number than 1 doesn't interrupt a paragraph; an empty item doesn't either.
    assert [t for _, t, _ in tree("a\n2. b\n*")] == ["Paragraph"]
    assert [t for _, t, _ in tree("-\n\n  a")] == ["List", "ListItem", "Paragraph"] and tree("-\n\n  a")[2][0] == 0


def test_tabs_are_columns():
    assert tree("-\ta\n\n\tb") == [(0, "List", "-\ta\n\n\tb"), (1, "ListItem", "-\ta\n\n\tb"), (2, "Paragraph", "a"), (2, "Paragraph", "b")]
    assert [t for _, t, _ in tree("-\t\tcode")] == ["List", "ListItem", "CodeBlock"]
    assert [t for _, t, _ in tree(">\t\tcode\n\n\tcode\n  \tcode")] == ["BlockQuote", "CodeBlock", "CodeBlock"]


def test_code_and_html():
    nodes = markdown.structure("```py x\na\n```\n~~~\n``` \n~~~~\n\n    a\n\n    b\n\n```\nopen").nodes
    body = lambda n: (n["body_span"]["start"], n["body_span"]["end"])
    assert [(n["info"], body(n)) for n in nodes] == [("py x", (8, 9)), ("", (18, 22)), (None, (33, 41)), ("", (47, 51))]
    assert [t for _, t, _ in tree("<div>\n*a*\n\n*b*\n<!-- x\n\ny -->\nz\n<b>\nq")] == ["HtmlBlock", "Paragraph", "HtmlBlock", "Paragraph"]
    assert spans("<div>\n*a*\n\n*b* <i title='*c*'>", "Emph") == [("Emph", "*b*")]


def test_headings_of_the_top_level():
    note = markdown.structure("# a #\n#b\n## c \\#\n\nd\ne\n===\n   ### \n- # in an item\n\nf\n---\n---\n    # code")
    assert [(h["level"], h["text"], h["setext"], h["start_col"], h["line"]) for h in note.headings] == [(1, "a", False, 1, 1), (2, "c \\#", False, 1, 3), (1, "d e", True, 1, 5), (3, "", False, 4, 8), (2, "f", True, 1, 11)]
    assert [h["address"] for h in note.headings] == ["1", "1.1", "2", "2.1", "2.2"] and [h["sec_end"] for h in note.headings] == [4, 4, 14, 10, 14]


def test_tables():
    text = "lead\n| a | b |\n|---|:-:|\n| `x\\|y` | *z* |\n| 1 | 2 | 3 |\n> q\n"
    assert tree(text) == [
        (0, "Paragraph", "lead"), (0, "Table", "| a | b |\n|---|:-:|\n| `x\\|y` | *z* |\n| 1 | 2 | 3 |"), (1, "TableRow", "| a | b |"), (2, "TableCell", "a"), (2, "TableCell", "b"),
        (1, "TableRow", "| `x\\|y` | *z* |"), (2, "TableCell", "`x\\|y`"), (2, "TableCell", "*z*"), (1, "TableRow", "| 1 | 2 | 3 |"), (2, "TableCell", "1"), (2, "TableCell", "2"), (0, "BlockQuote", "> q"), (1, "Paragraph", "q"),
    ]
    assert spans(text) == [("Emph", "*z*")]
    assert [t for _, t, _ in tree("| a | b |\n| --- |")] == ["Paragraph"]


def test_definitions_and_gaps():
    text = "[a]: /u\n'title\nover lines'\n[^1]: http://x\n\n[two\nlines]: <b c>\n[A] [x][two lines] [^1] [nope]\n\n[a]: /second\n\n[bad]: /u junk"
    assert [(t, s) for _, t, s in tree(text)] == [
        ("LinkReferenceDefinition", "[a]: /u\n'title\nover lines'\n[^1]: http://x"), ("Unknown", "[two\nlines]: <b c>"), ("Paragraph", "[A] [x][two lines] [^1] [nope]"),
        ("LinkReferenceDefinition", "[a]: /second"), ("Paragraph", "[bad]: /u junk"),
    ]
    links = [x for x in markdown.structure(text).inlines if x["type"] == "Link"]
    assert [(x["url"], x["title"]) for x in links] == [("/u", "title\nover lines"), ("b c", None), ("http://x", None)]


@pytest.mark.parametrize(("text", "want"), [
    ("*a **b** c*", ["*a **b** c*", "**b**"]), ("***a** b*", ["***a** b*", "**a**"]), ("***a* b**", ["***a* b**", "*a*"]), ("a_b_c _d_", ["_d_"]), ("a*b*c", ["*b*"]), ("** a** *b *", []),
    ("*(*a*)*", ["*(*a*)*", "*a*"]), ("*a`*`b*", ["*a`*`b*"]), ("\\*a* *b\\*", []), ("*a _b* c_", ["*a _b*"]), ("__a__b__", ["__a__b__"]), ("**a*b**", ["**a*b**"]), ("*a\nb*", ["*a\nb*"]), ("foo***bar***baz", ["***bar***", "**bar**"]),
    ("[*a](b)*", []), ("*[a*](b)", []), ("“*a*”b", ["*a*"]), ("*a <i title='*'>b*", ["*a <i title='*'>b*"]),
])
def test_emphasis_by_flanking(text, want):
    assert [s for _, s in spans(text, "Emph", "Strong")] == want


@pytest.mark.parametrize(("text", "want"), [
    ("[a](b 'c') [d](<e f>) [g]( h )", ["[a](b 'c')", "[d](<e f>)", "[g]( h )"]), ("[a [b](c) d](e)", ["[b](c)"]), ("[![i](j)](k)", ["[![i](j)](k)", "![i](j)"]), ("![a ![b](c) [d](e)](f)", ["![a ![b](c) [d](e)](f)", "![b](c)", "[d](e)"]),
    ("[a](b(c)d) [e](f\\)g)", ["[a](b(c)d)", "[e](f\\)g)"]), ("[a] (b) [c](d e)", []), ("`[a](b)` \\[c](d)", []), ("[a\n*b*](c)", ["[a\n*b*](c)"]), ("> [a\n> b](c)", ["[a\n> b](c)"]), ("[a]()", ["[a]()"]),
])
def test_links_and_images(text, want):
    assert [s for _, s in spans(text, "Link", "Image")] == want


def test_wikilinks_and_addresses():
    text = "[[a|b]] ![[c#^d|e|f]] [[g|h|i]] \\![[j]] `[[k]]` [[__init__]] www.x.org/(a)). (https://y.z/q?a=1&amp;) <mailto:m@n.o> p.q@r.st! [in www.no.way](u)"
    assert [s for _, s in spans(text)] == ["[[a|b]]", "![[c#^d|e|f]]", "[[j]]", "`[[k]]`", "[[__init__]]", "www.x.org/(a)", "https://y.z/q?a=1", "<mailto:m@n.o>", "p.q@r.st", "[in www.no.way](u)"]
    link = markdown.structure(text).inlines[1]
    assert (link["target"], link["page"], link["block"], link["alias"], link["embed"]) == ("c#^d", "c", "d", "e|f", True)
    one = markdown.structure("é*ü*ñ").inlines[0]
    assert (one["span"], one["before"], one["after"]) == ({"start": 2, "end": 6}, "é", "ñ")


def test_anchors_in_code_and_comments_are_inert():
    note = markdown.structure("<!-- a -->\n`<!-- b -->`\n\n    <!-- c -->\n\n<!-- x\n<!-- d -->\n\n- <!-- e: f -->\n  y <!-- /e -->\n\n<!-- /a -->\n<!-- /g -->")
    assert [(r["label"], r["info"], r["start_line"], r["end_line"]) for r in note.regions] == [("a", None, 1, 12), ("e", "f", 9, 10)]
    assert [(d["kind"], d["label"]) for d in note.dangling] == [("close", "g")]


@pytest.mark.parametrize("text", ["*a " * 20000, "[" * 30000, "`a" * 20000, "**a _b " * 8000, "![a](" * 8000, "[a](<b" * 5000, "<!-- " * 8000, "> " * 3000 + "\n" + "a\n" * 50])
def test_no_text_takes_long(text):
    markdown.structure(text)


signs = st.text(alphabet=st.sampled_from(list("ab*_[]()!`~<>#-+=1.):|\\\"' \t\n\r&é")), max_size=120)


@settings(max_examples=600, deadline=None)
@given(signs)
def test_blocks_claim_all_text_once(text):
    note = markdown.structure(text)
    raw = text.encode()
    tops = sorted((s["start"], s["end"]) for s in [h["span"] for h in note.headings] + [n["span"] for n in note.nodes if n["depth"] == 0])
    at = len(raw) if text.startswith("---") and markdown.body_of(text)[0] is not None else 0
    for a, b in tops if not at else []:
        assert a >= at and not raw[at:a].decode().strip(" \t\r\n")
        at = b
    assert not raw[at:].decode().strip(" \t\r\n")
    for n in note.nodes:
        if n["parent_seq"] is not None:
            outer = note.nodes[n["parent_seq"]]["span"]
            assert outer["start"] <= n["span"]["start"] <= n["span"]["end"] <= outer["end"]
    ranges = [(x["span"]["start"], x["span"]["end"]) for x in note.inlines]
    assert all(not (a < c < b < d) for a, b in ranges for c, d in ranges)
    assert len(markdown.block_lines(text.split("\n"), markdown.body_of(text)[1])) == text.count("\n") + 1

"""Groups, links and corpus-wide counts of two tokenizers, against the libraries and plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

pytest.importorskip("notewell.llm")
from notewell.llm import token_alignment as ta
from notewell.llm.token_counts import PieceModel

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\t", "a", "The unbelievable tokenization of internationalisation.", "don't we'll 'sup", "é½Ⅷ²漢字😀 <|endoftext|> </s><unk>", "has a ▁ mark", "x" * 3000,
    "  two  blanks \n\n lines\r\n", "\x00\x1c\x85\xa0", "word " * 700, "word " * 700, "ñandú señora ciónñgaco", "<0x0A> literal",
]


def brute(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {**{v: v for v in visible}, **{256 + i: v for i, v in enumerate(sorted({*range(256)} - {*visible}))}}
    docs = []
    for key, text in rows:
        if not text:
            docs.append((key, [], [], [], []))
            continue
        coded = a_lib.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[ord(c)] for c in t)) for i, t in zip(coded.ids, coded.tokens, strict=True)]
        b = [(i, bytes([int(p[1:-1], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
        want = (" " + text).encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            docs.append((key, [], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, before = [], 0
        for c in cuts:
            groups.append([[i for i, s, e in side if before <= s and e <= c] for side in spans] if len(cuts) < 400 else None)
            before = c
        docs.append((key, a, b, groups, links))
    counts = Counter(x for d in docs for x in d[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, a, b, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups) if None not in groups else None
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((key, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


@pytest.mark.parametrize("frequent, held", [(1 << 19, 1 << 21), (40, 8)])
def test_summaries_agree_with_the_libraries(spark, monkeypatch, frequent, held):
    monkeypatch.setattr(ta, "FREQUENT", frequent)
    monkeypatch.setattr(ta, "HELD", held)
    rows = [*enumerate(ODD), (5, ODD[5]), (None, "no key"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_a int, row int, id string").repartition(3)
    got = sorted(map(tuple, ta.summaries(docs, A, B).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, want, strict=True)) and sum(w[7] is not None for w in want) > 12
    assert ta.summaries(docs.limit(0), A, B).count() == 0


def test_summaries_of_documents_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    got = sorted(map(tuple, ta.summaries(docs, A, B).collect()), key=str)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, want, strict=True))


def test_groups_are_rows(spark):
    docs = spark.createDataFrame([(1, "The unbelievable tokenization"), (2, None), (3, "tokenization ñandú")], "doc_id long, text string")
    ids = ta.encoded(docs, A, B)
    sizes = spark.sparkContext.broadcast((ta.byte_tokens(open(A, encoding="utf-8").read()).sizes, ta.piece_tokens(PieceModel(open(B, "rb").read())).sizes))
    want = {r.id: (np.frombuffer(r.a, "<u2").tolist(), np.frombuffer(r.b, "<u2").tolist()) for r in ids.collect()}
    rows = ta.alignments(ids, sizes).join(ids.select("row", "id"), "row").orderBy("id", "seq").collect()
    assert {r.id for r in rows} == {1, 3}
    for key in (1, 3):
        assert [x for r in rows if r.id == key for x in r.a] == want[key][0] and [x for r in rows if r.id == key for x in r.b] == want[key][1]
        assert [r.seq for r in rows if r.id == key] == list(range(sum(r.id == key for r in rows)))


def test_union_find():
    draw = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (2000, 1500), (3000, 2999)):
        one, two = (np.arange(m), np.arange(m) + 1) if m == n - 1 and m else draw.integers(0, n, (2, m))
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(one.tolist(), two.tolist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        assert ta.union_find(n, one, two).tolist() == [find(x) for x in range(n)]

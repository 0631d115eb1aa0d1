"""Ranked search against scores of all documents in plain Python, and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("notewell.llm")
from notewell.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in docs]
    terms = [(key, c, c.total()) for key, c in terms if c]
    n_docs, words = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall((text or "").translate(LOWER))), []
        for key, c, n in terms:
            m = 100 - 25 + 25 * n * n_docs // words
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, i + 1, key, -score) for i, (score, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made(seed, n_docs, n_items):
    draw = random.Random(seed)
    vocabulary = ["The", "of", "é", "漢字", "x1", *[f"w{i}" for i in range(60)]]
    weights = [40, 30, 8, 3, 2, *[60 / (i + 1) for i in range(60)]]
    text = lambda most: " ,.\n-"[draw.randrange(5)].join(draw.choices(vocabulary, weights, k=draw.randrange(most)))
    docs = [(i, text(60)) for i in range(n_docs)]
    docs += [(i + 1000, docs[3][1]) for i in range(30)]
    return docs, [(i, text(12)) for i in range(n_items)]


def run(spark, docs, items, k=20):
    d = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in docs], "doc_id long, text string, item_id int, score int, n int").repartition(3)
    i = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "item_id long, text string, doc_id int, rank int")
    return sorted(map(tuple, ranked_search.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("k, cells, items_a_block", [(20, 1 << 21, 2000), (3, 40, 2000), (5, 1 << 21, 7)])
def test_ranks_agree_with_all_scores(spark, monkeypatch, k, cells, items_a_block):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    monkeypatch.setattr(ranked_search, "ITEMS", items_a_block)
    docs, items = made(k, 300, 20)
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (4, "Alpha alpha"), (5, "alpha"), (5, "alpha"), (None, "alpha"), (6, "ALPHA É é"), (7, "beta " * 5000 + "alpha"), (8, "gamma")]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "alpha Alpha É"), (None, "gamma"), (5, "nothing here"), (6, "gamma " * 3000)]
    assert run(spark, docs, items) == brute(docs, items, 20)
    assert run(spark, docs, [*items, (1, "zeta")]) == brute(docs, items, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_suffixes_prune_and_lose_nothing():
    # One rare term of high impact, and three that nearly all documents have.
    plan = ranked_search.Plan([{0: 1, 1: 1, 2: 1, 3: 1}], np.array([9000, 300, 200, 100]), np.array([900_000] * 4), np.array([700_000] * 4))
    assert plan.seed.tolist() == [9000 * 700_000] and plan.item.tolist() == [0] and plan.rest.tolist() == [600 * 900_000]
    # Without a seed, all terms make candidates.
    plan = ranked_search.Plan([{0: 1, 1: 1}], np.array([9000, 300]), np.array([900_000] * 2), np.array([0, 0]))
    assert plan.item.tolist() == [0, 0] and plan.rest.tolist() == [0]


def test_terms_with_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(ranked_search, "piece_hashes", lambda codes, starts, ends: np.full(len(starts), 5, np.uint64))
    words = ranked_search.Vocabulary(["one", "two", "six"])
    data = np.frombuffer(b"six one ten two", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15])
    at, term = words.find(data, starts, ends, np.full(4, 5, np.uint64))
    assert dict(zip(at.tolist(), term.tolist(), strict=True)) == {0: 2, 1: 0, 3: 1}


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = sorted(map(tuple, con.execute(ranked_search.SQL).fetchall()), key=str)
    got = ranked_search.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 100

"""Links, components and odd rows of embeddings, against all pairs."""

import numpy as np
import pytest

pytest.importorskip("notewell.llm")
from notewell.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, n_links int, component_id int, key int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component, kept) of each row by all pairs."""

    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [set() for _ in range(n)]
    units = {i: np.array(r[1], float) / np.abs(r[1]).max() for i, r in enumerate(rows) if usable(r[1], r[2])}
    for i in units:
        for j in units:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                x, y = units[i], units[j]
                if (x @ y) / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        keys = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(keys) if keys else None
        out.append((rows[i][0], len(near[i]), component, rows[i][0] == component))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, embedding_dedup.links(df).collect()), key=str)


def families(seed, n, noise):
    """Vectors around drawn centres, some of which chain into one another."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0:
            now = draw.standard_normal(24)
        now = now + noise * draw.standard_normal(24)
        rows.append((int(i), (now * draw.uniform(0.1, 9)).tolist(), int(draw.integers(0, 2))))
    return rows


@pytest.mark.parametrize("block", [1024, 5])
def test_links_agree_with_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAST_BITS", 2 if block == 5 else 6)
    rows = families(5, 400, 0.22)
    want = brute(rows)
    assert sum(r[1] for r in want) > 100 and len({r[2] for r in want}) > 50
    assert run(spark, rows) == want


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (7, v, 1), (3, v, 1), (3, v, 1), (5, v, None), (6, None, 1), (8, [], 1), (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 2.0], 1),
        (11, [float("nan"), 1.0, 1.0], 1), (12, [float("inf"), 1.0, 1.0], 1), (13, [1e300, 2e300, 3e300], 1), (14, [1e-300, 2e-300, 3e-300], 1),
        (15, [1.0, 2.0], 1), (None, [2.0, 1.0, -3.0], 1), (None, None, 2), (16, [-1.0, -2.0, -3.0], 1), (17, v, 2), (18, [-0.0, 1.0, 0.0], 2), (19, [0.0, 1.0, 0.0], 2),
    ]
    want = [r if r[2] is not None else (*r[:3], True) for r in brute(rows)]
    assert run(spark, rows) == sorted(want, key=str)
    assert run(spark, []) == []


def test_very_many_copies_and_one_chain(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(2)
    v, w = draw.standard_normal(16), draw.standard_normal(16)
    w -= v * (v @ w) / (v @ v)
    turns = [np.cos(a) * v / np.linalg.norm(v) + np.sin(a) * w / np.linalg.norm(w) for a in np.arange(0, 3, 0.05)]
    rows = [(1000 + i, v.tolist(), 1) for i in range(300)] + [(500 - i, t.tolist(), 1) for i, t in enumerate(turns)]
    assert run(spark, rows) == brute(rows)


def test_plan_keeps_the_recall():
    near = 1 - np.arccos(0.93) / np.pi
    for n in (1, 1000, 10**6, 10**9):
        bits, tables = embedding_dedup.plan(n, 0.93)
        assert 1 - (1 - near**bits) ** tables >= embedding_dedup.RECALL and n / 2**bits <= embedding_dedup.BUCKET
    draw = np.random.default_rng(1)
    x = embedding_dedup.unit(draw.standard_normal((4000, 64)))
    y = draw.standard_normal((4000, 64))
    y = embedding_dedup.unit(y - x * (x * y).sum(1)[:, None])
    bits, tables = embedding_dedup.plan(10**6, 0.93)
    met = (embedding_dedup.signatures(x, bits, tables) == embedding_dedup.signatures(0.93 * x + np.sqrt(1 - 0.93**2) * y, bits, tables)).any(1)
    assert met.mean() > 0.997

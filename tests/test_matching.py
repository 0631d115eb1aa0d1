"""Names and quotes: the same matches as comparing everything, from few comparisons."""

import random
import re

import pytest
from notewell.operators import distill
from notewell.queries import distill as queries
from pyspark.sql import functions as F


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def cap(a, b):
    return min(3, max(len(a), len(b)) // 3)


def edited(draw, name):
    for _ in range(draw.randrange(5)):
        at = draw.randrange(len(name) + 1)
        name = draw.choice([name[:at] + draw.choice("abx é") + name[at:], name[:at] + name[at + 1 :], name[:at] + draw.choice("abx") + name[at + 1 :]])
    return name


@pytest.mark.parametrize("length", [4, 12, 23, 26, 40])
def test_near_names_are_those_of_all_pairs(spark, length):
    draw = random.Random(length)
    known = list(dict.fromkeys("Common " * (length // 20) + "".join(draw.choices("abc", k=draw.randrange(length - 3, length + 4) - 7 * (length // 20))) for _ in range(60)))
    names = list(dict.fromkeys(edited(draw, draw.choice(known)) for _ in range(150)))
    got = distill.near_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n, -i) for i, n in enumerate(known)], "name string, ord int"))
    want = set()
    for n in names:
        near = [(lev(n, k), -i, k) for i, k in enumerate(known) if n and lev(n, k) <= cap(n, k)]
        if near:
            d, _, k = min(near)
            want.add((n, k, d))
    assert {tuple(r) for r in got.select("name", "match", "distance").collect()} == want and len(want) > 30
    pairs = distill.near_pairs(spark.createDataFrame([(n,) for n in names + known], "name string"))
    every = sorted({*names, *known} - {""})
    assert {tuple(r) for r in pairs.collect()} == {(a, b, lev(a, b)) for i, a in enumerate(every) for b in every[i + 1 :] if lev(a, b) <= cap(a, b)}


def test_names_with_much_in_common_make_few_pairs(spark, monkeypatch):
    made = []
    compared = distill._compared

    def counted(pairs):
        made.append(pairs.count())
        return compared(pairs)

    monkeypatch.setattr(distill, "_compared", counted)
    sf = "/root/testdata/sf0.1"
    assert queries.fuzzy_names(spark, sf).count() > 10_000
    names, known = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert names * known == 15_000_000 and sum(made) < names * known / 100


def brute_snap(quotes, blocks):
    plain = lambda s: re.sub(r"[\W_]+", " ", re.sub(r"!?\[\[([^\]]*)\]\]", r"\1", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", s)).lower()).strip()
    out = set()
    for i, quote in quotes:
        q = plain(quote)
        words = set(q.split())
        if not words:
            out.add((i, None, None, None, "no words"))
            continue
        held = [(len(plain(b)), n) for n, b in blocks if f" {q} " in f" {plain(b)} "]
        shared = [(-len(words & set(plain(b).split())), n) for n, b in blocks if words & set(plain(b).split())]
        if held:
            out.add((i, min(held)[1], "contains", 1.0, None))
        elif shared:
            out.add((i, min(shared)[1], "overlap", round(-min(shared)[0] / len(words), 6), None))
        else:
            out.add((i, None, None, None, "no block shares a word"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_quotes_fall_where_all_blocks_are_compared(spark, seed):
    draw = random.Random(seed)
    words = ["the", "of", *[f"w{i}" for i in range(50)]]
    text = lambda n: " ".join(draw.choices(words, [40, 30, *[20 / (i + 1) for i in range(50)]], k=n))
    blocks = [(n, text(draw.randrange(0, 25))) for n in range(120)]
    quotes = [(0, ""), (1, "--"), (2, "zzz"), (3, "the"), (4, "of the zzz"), (5, "[W1](u) the!")]
    for i in range(6, 90):
        cut = draw.choice([b for _, b in blocks if len(b.split()) > 4]).split()
        a = draw.randrange(len(cut) - 2)
        part = cut[a : a + draw.randrange(2, 9)]
        if i % 2:
            part.insert(draw.randrange(len(part) + 1), draw.choice(["zzz", "the", "w3"]))
        quotes.append((i, " ".join(part)))
    got = distill.snap(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(blocks, "n int, block string"))
    assert {(r.quote_id, r.n, r.how, None if r.score is None else round(r.score, 6), r.error) for r in got.collect()} == brute_snap(quotes, blocks)


def test_stop_words_join_nothing(spark):
    blocks = spark.range(2000).select(F.col("id").alias("n"), F.concat(F.lit("the of and rare"), "id", F.lit(" word"), F.col("id") % 50).alias("block"))
    quotes = spark.range(400).select(F.col("id").alias("quote_id"), F.concat(F.lit("the of and rare"), "id", F.lit(" more"), "id").alias("quote"))
    pairs = distill.snap_candidates(quotes, blocks)
    assert pairs.count() == 400
    assert distill.snap(quotes, blocks).where("n = quote_id and how = 'overlap' and score = 0.8").count() == 400

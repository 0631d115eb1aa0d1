"""The index: the same hits as scoring every note, from its own tables alone."""

import math
import random
import shutil
from collections import Counter

import pytest
from notewell.operators import index, review, search
from pyspark.sql import functions as F

WORDS = ["the", "of", *[f"w{i}" for i in range(40)]]


@pytest.fixture(scope="module")
def made():
    draw = random.Random(7)
    weights = [40, 25, *[40 / (i + 1) for i in range(40)]]
    rows = []
    for i in range(400):
        body = " ".join(draw.choices(WORDS, weights, k=draw.choice([0, 3, 20, 60, 400])))
        rows.append((f"n/{i:03}.md", f"note {draw.choice(WORDS)}", draw.choice(["about w1", "w2 w3", None]), draw.choice(["card", "note"]), draw.choice(["certified", "provisional", "superseded"]), len(body) // 4, body))
    return rows + [(f"z/{i}.md", *rows[5][1:]) for i in range(30)]


@pytest.fixture()
def notes(spark, made, tmp_path):
    schema = "rel string, name string, description string, type string, tier string, tokens int, body string"
    spark.createDataFrame(made, schema).write.parquet(str(tmp_path / "notes"))
    return spark.read.parquet(str(tmp_path / "notes"))


def hits(df):
    return [(r.rel, round(r.score, 9)) for r in sorted(df.collect(), key=lambda r: (-round(r.score, 9), r.rel))]


@pytest.mark.parametrize("query", ["w1", "the", "w3 w17 of", "the AND w20", "w9 NOT the", "w1 AND w2 OR w30 NOT of", "none", "the none"])
def test_hits_are_those_of_all_notes(spark, notes, tmp_path, monkeypatch, query):
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    monkeypatch.setattr(index, "LEAD", 2)
    found = index.build(notes, str(tmp_path / "index"), stem=False)
    asked = search.parse_query(query, stem=False)
    want = hits(search.bm25(notes, asked, stem=False))
    # The source is gone: a query reads nothing but the index.
    shutil.rmtree(tmp_path / "notes")
    found = index.open_index(spark, found.path)
    boosts = search.BOOSTS
    assert hits(index.top(found, asked, 15, boosts)) == want[:15]
    scale = {"certified": 1.0, "provisional": 0.6, "superseded": 0.3}
    tiers = {r.rel: r.tier for r in found.table("docs").collect()}
    cards = {r.rel for r in found.table("docs").where("type = 'card'").collect()}
    scaled = {rel: s * scale[tiers[rel]] for rel, s in want if rel in cards}
    got = hits(index.top(found, asked, 9, boosts, F.col("type") == "card", scaled=True))
    assert [s for _, s in got] == pytest.approx(sorted(scaled.values(), reverse=True)[:9]) and [s for _, s in got] == pytest.approx([scaled[rel] for rel, _ in got])


def test_filters_on_terms_reach_the_scan(notes, tmp_path):
    found = index.build(notes, str(tmp_path / "index"), stem=False)
    plan = found.table("postings").where(F.col("term").isin("w1", "w2"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [w1,w2])]" in plan
    assert found.table("terms").where("term = 'the'").count() == 2


def test_lengths_of_one_byte(spark):
    rows = spark.range(0, 200000, 7).select(F.col("id").alias("n"), index.length_code(F.col("id")).alias("c"))
    bad = rows.where((index.length_below(F.col("c")) > F.col("n")) | (index.length_above(F.col("c")) < F.col("n")) | (index.length_above(F.col("c")) > F.col("n") * 1.13 + 2))
    assert bad.count() == 0 and rows.select("c").distinct().count() > 100


@pytest.mark.parametrize("bits", [3, 12])
def test_neighbours_are_those_of_all_pairs(spark, notes, made, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(index, "BLOCK_BITS", bits)
    asked = [(1, "the of w1 w5 w39"), (2, "the"), (3, "w7 of the the"), (4, ""), (5, "unknown words"), (6, None), (7, " ".join(WORDS))]
    got = review.neighbours(notes, spark.createDataFrame(asked, "candidate int, text string"), str(tmp_path / "near"), k=4)
    docs = [(r[0], Counter(" ".join(x for x in (r[1], r[2], r[6]) if x).split())) for r in made if r[4] != "superseded"]
    average = sum(c.total() for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    want = []
    for key, text in asked:
        scores = []
        for rel, c in docs:
            s = sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t in set((text or "").split()) if c[t])
            if s:
                scores.append((-round(s, 9), rel))
        want += [(key, i + 1, rel, -s) for i, (s, rel) in enumerate(sorted(scores)[:4])]
    assert sorted((r.candidate, r["rank"], r.rel, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_common_terms_make_no_pairs(spark, tmp_path):
    rows = [(f"{i}.md", "n", "", "card", "certified", 1, "the of " + (f"rare{i % 40} rare{i % 40}" if i % 2 else "the")) for i in range(400)]
    notes = spark.createDataFrame(rows, "rel string, name string, description string, type string, tier string, tokens int, body string")
    found = index.build(notes, str(tmp_path / "index"), {"text": ("name", "description", "body")}, stem=False, carry=())
    near = index.neighbours(found, spark.createDataFrame([(i, f"the of rare{2 * i + 1}") for i in range(20)], "candidate int, text string"), k=3)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan()
    assert near.count() == 60 and plan is not None
    terms = {r.term: r for r in found.table("terms").collect()}
    idf = {t: math.log1p((400 - terms[t].df + 0.5) / (terms[t].df + 0.5)) for t in ("the", "of", "rare1")}
    # Ten notes have a rare term, so it alone reaches the kth score, and the common ones together don't.
    assert idf["rare1"] * terms["rare1"].kept[2] > idf["the"] * terms["the"].top + idf["of"] * terms["of"].top


def test_snippets_take_the_best_window(spark):
    rows = [("a", "apple " + "x " * 40 + "apple pear fig " + "y " * 40 + "pear"), ("b", "no match here"), ("c", "Pear " + "z" * 200), ("d", ""), ("e", "fig apple " + "q " * 60 + "fig apple fig")]
    got = {r.rel: r.snippet for r in search.snippets(spark.createDataFrame(rows, "rel string, body string"), ["apple", "fig", "pear"], width=30).collect()}
    assert "apple pear fig" in got["a"] and len(got["a"]) == 30
    assert got["b"] == "no match here" and got["c"].startswith("Pear zzz") and got["d"] == "" and got["e"].endswith("fig apple fig")


def test_search_by_index_describes_hits(notes, tmp_path):
    found = index.build(notes, str(tmp_path / "index"))
    rows = index.search(found, "w39 w38", limit=5, types=("card",), drop_superseded=True).collect()
    assert len(rows) == 5 and all(r.type == "card" and not r.superseded and any(w in r.snippet or w in r.title for w in ("w38", "w39")) for r in rows)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_postings_are_shuffled_once(spark, notes, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet

    def look(self, path, *a, **k):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", look)
    index.build(notes, str(tmp_path / "once"), stem=False)
    assert plans["postings"].count("Exchange") == 1


@pytest.mark.parametrize("rows", [0, 1000])
def test_neighbours_ask_for_few_terms_and_notes(spark, notes, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(index, "BROADCAST_TERMS", rows)
    monkeypatch.setattr(index, "BROADCAST_NOTES", rows)
    made = index.build(notes, str(tmp_path / f"few{rows}"), {"text": ("name", "description", "body")}, stem=False, carry=())
    asked = notes.select("rel", "body").orderBy("rel").limit(3).select(F.col("rel").alias("candidate"), F.col("body").alias("text"))
    found = index.neighbours(made, asked, k=3)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) or not rows
    first = {r.candidate: r.rel for r in found.where("rank = 1").collect()}
    assert len(first) == 3


def test_words_begin_as_their_stem_does():
    from notewell.functions import stem

    draw = random.Random(5)
    ends = [x for x, _ in stem.STEP2 + stem.STEP3] + stem.STEP4 + ["s", "ed", "ing", "eed", "ies", "y", "ll", "sses", "edly", "", "", *"ившись вши его ость ейше нн ь ся ую ями ешь".split()]
    for _ in range(20000):
        word = "".join(draw.choice(draw.choice(["abeilnstyz", "абеёиклностя"])) for _ in range(draw.randint(1, 5))) + draw.choice(ends) + draw.choice(ends)
        assert word.replace("ё", "е").startswith(stem.beginning(stem.stem(word))), word
    assert all(w.startswith(stem.beginning(s)) for w, s in stem.SPECIAL.items())


@pytest.mark.parametrize("query", ["skies", "hoping nationally", "ёлками", "skies NOT hoped"])
def test_scored_notes_are_read_once_and_stemmed_as_a_whole(spark, query):
    from notewell.functions.stem import stem
    from notewell.operators import notes as N

    bodies = ["the sky hopes", "skies and national hoping", "nations hope ёлка елками", "ёлки skying dyed", "", "hoped sky sky"]
    files = spark.createDataFrame([(f"n{i}.md", f"---\ntype: card\ndescription: d\n---\n{b}") for i, b in enumerate(bodies)], "rel string, content string")
    scored = search.bm25(N.parse(files), search.parse_query(query))
    assert "ArrowEvalPython" not in scored._jdf.queryExecution().optimizedPlan().toString()
    wanted, barred = query.split(" NOT ")[0].split(), query.split(" NOT ")[1:]
    holds = lambda b, q: {stem(w) for w in b.split()} & {stem(w) for w in q}
    assert {r.rel for r in scored.collect()} == {f"n{i}.md" for i, b in enumerate(bodies) if holds(b, wanted) and not holds(b, barred)}
    assert "ArrowEvalPython" not in search.search(N.parse(files), query)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cells", [5, 2_000_000])
def test_few_candidates_are_scored_as_notes_are_read(spark, notes, tmp_path, monkeypatch, cells):
    asked = spark.createDataFrame([("a", "the of w1 w5 w39"), ("b", "the"), ("c", "w7 of the the"), ("d", ""), ("e", "unknown"), ("f", None), ("g", " ".join(WORDS))], "candidate string, text string")
    shown = lambda df: sorted((r.candidate, r["rank"], r.rel, round(r.score, 9)) for r in df.collect())
    monkeypatch.setattr(index, "BATCH", 0)
    want = shown(review.neighbours(notes, asked, str(tmp_path / "all"), k=4))
    monkeypatch.setattr(index, "BATCH", 100)
    for name in ("CELLS", "PRODUCTS"):
        monkeypatch.setattr(index, name, cells)
    found = review.neighbours(notes, asked, str(tmp_path / "few"), k=4)
    assert shown(found) == want and len(want) == 16
    # No table of postings, and no text is shuffled: what is left of a note is counts of the batch's terms.
    assert sorted(p.name for p in (tmp_path / "few").iterdir()) == ["counts"]
    assert review.neighbours(notes, asked.where("candidate = 'd'"), str(tmp_path / "none"), k=4).count() == 0

import pytest

pytest.importorskip("notewell.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from notewell.llm import jaccard_join, line_templates, quality_rules, source_mix

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
from notewell.llm.support import written

SF = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "line dedup":
            want = {r.doc_id: r.text for r in line_templates.dedup(docs, min_chars=8, keep_copies=True).collect() if r.text.strip()}
        elif name == "near duplicates":
            want = {r.doc_id for r in jaccard_join.join(docs).where("doc_id = component_id").collect()}
        elif name == "source mix":
            want = {r.doc_id: round(r.taken / r["size"]) for r in source_mix.mix(docs).collect()}
        docs = written(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        if name != "token ids":
            assert docs.columns == columns
        if name == "quality rules":
            assert {r.doc_id for r in rows} == kept
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near duplicates":
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif name == "source mix":
            counts: dict = {}
            for r in rows:
                assert r.text == before[r.doc_id]
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert all(abs(counts.get(k, 0) - n) <= 1 for k, n in want.items()) and max(counts.values()) <= 2
        else:
            assert sorted(r.doc_id for r in rows) == sorted(k for k, n in counts.items() for _ in range(n))


def test_near_duplicates_of_texts_that_share_a_doc_id(spark):
    own = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(5, own("a"), "en", "s", 1), (3, own("a") + " end", "en", "s", 1), (5, own("b"), "en", "s", 1), (5, own("c"), "en", "s", 1), (3, own("d"), "en", "s", 1)]
    rows += [(9, own("e"), "en", "s2", 1), (9, own("e"), "en", "s1", 1), (None, own("a"), "en", "s", 1), (7, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([rows[i] for i in (1, 2, 3, 4, 6, 7, 8)], key=str)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    own = lambda x, n=80: " ".join(f"{x}{word(i)} the" for i in range(n))
    rows = [(1, own("a"), "en", "s1", 9), (1, own("a"), "en", "s1", 9), (1, own("b"), None, None, None), (2, own("c"), "en", None, 3), (None, own("d"), "en", "s2", 1), (None, own("d"), "en", "s2", 1)]
    rows += [(3, None, "en", "s1", None), (4, "", None, "s1", 0), (5, " \n ", "de", None, 3), (6, own("e", 30_000), "en", "s1", 7), (7, own("f", 120) + "\n" + own("a"), "", "", 5)]
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCUMENTS + ", id long, row string, copies long, size long")


def test_stages_on_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = odd(spark)
        got = stage(spark, docs, SF)
        assert name == "token ids" or got.columns == corpus_pipeline.COLUMNS
        rows = sorted(map(tuple, got.select("doc_id", *(["text"] if name != "token ids" else ["n_tokens"])).collect()), key=str)
        assert rows == sorted(map(tuple, stage(spark, docs, SF).select("doc_id", *(["text"] if name != "token ids" else ["n_tokens"])).collect()), key=str)
        ids = [r[0] for r in rows]
        if name == "quality rules":
            assert ids.count(1) == 3 and ids.count(None) == 2 and not {3, 4, 5} & set(ids) and {2, 6, 7} <= set(ids)
        elif name == "line dedup":
            # The copy of a's line in document 7, less than half of it, goes, and what repeats the rows without doc_id is theirs.
            assert not {3, 4, 5} & set(ids) and ids.count(None) == 2 and len(next(t for i, t in rows if i == 7).split()) == 240
        elif name == "near duplicates":
            assert ids.count(1) == 2 and ids.count(None) == 2 and {2, 3, 4, 5, 6, 7} <= set(ids)
        elif name == "token ids":
            assert len(rows) == 11 and dict(r for r in rows if r[0] is not None)[3] == 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_documents_with_one_doc_id_are_mixed_by_their_texts(spark):
    own = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    rows = [(5, own("a", 500), "en", "s1", 1), (5, own("b", 400), "en", "s2", 1), (6, own("c", 3000), "en", "s3", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    want = {(r.doc_id, r.source): round(r.taken / r["size"]) for r in source_mix.mix(docs).collect()}
    got: dict = {}
    for r in corpus_pipeline.mixture(spark, docs, SF).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_the_mix_of_whole_documents_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {r.source: r.target for r in source_mix.mix(docs).select("source", "target").distinct().collect()}
    words, longest = {}, {}
    for r in corpus_pipeline.mixture(spark, docs, SF).select("source", "text").collect():
        n = len(r.text.split())
        words[r.source] = words.get(r.source, 0) + n
    for r in docs.select("source", "text").collect():
        longest[r.source] = max(longest.get(r.source, 0), len((r.text or "").split()))
    # A shard's run begins and ends within a document: each may add or lose half of one.
    assert all(abs(words[s] - t) <= longest[s] * (1 + t / source_mix.SHARD) + source_mix.BLOCK for s, t in target.items())

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("notewell.llm")
from notewell.llm import jaccard_join as jj


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), k), k)
    return sorted((k, len(sets[i]), low[root(i)]) for i, (k, _) in enumerate(rows))


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcd") for _ in range(r.randrange(1, 6)))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(r.choice([3, 8, 40, 150]))] for _ in range(n // 5)]
    texts = []
    for _ in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randrange(0, 1 + len(words) // 15)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append(r.choice([" ", "\n", "  "]).join(words).replace("a", r.choice("aA")))
    return texts


def test_components_agree_with_all_pairs(spark):
    texts = made(1, 240) + ["", None, " \n", "One two", "one TWO", "one"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute(rows)


def test_large_groups_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "GROUP", 2000)
    monkeypatch.setattr(jj, "BLOCK", 700)
    monkeypatch.setattr(jj, "SMALL", 4)
    rows = list(enumerate(made(2, 200)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute(rows)


def test_rows_without_key_or_words_and_clashing_names(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text, 1, 2), (3, text, 1, 2), (None, text, 1, 2), (1, text, None, 2), (None, None, 1, 2)], "doc_id long, text string, n long, component_id long")
    got = sorted(map(tuple, jj.join(docs).collect()), key=str)
    assert got == sorted([(3, 3, 1), (3, 3, 1), (None, 3, None), (1, 3, 1), (None, 0, None)], key=str)
    assert jj.join(docs.limit(0)).count() == 0


def test_group_components_of_a_star():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 60, 200).astype(np.uint64))
    rows = []
    for _ in range(60):
        own = base.copy()
        own[r.integers(0, len(base), 8)] = r.integers(0, 1 << 60, 8).astype(np.uint64)
        rows.append(np.unique(own))
    rows.append(np.unique(r.integers(0, 1 << 60, 200).astype(np.uint64)))
    roots = jj.group_components(jj._Sets.of([x.tobytes() for x in rows]))
    assert len(set(roots[:60].tolist())) == 1 and roots[60] != roots[0]


def test_batches_do_not_mix_texts():
    column = pa.array(["a b", "c d e f g h", None, "", "a b"])
    values, offsets = jj.shingle_sets(column, 5)
    assert np.diff(offsets).tolist() == [1, 2, 0, 0, 1] and values[0] == values[3]


def test_large_group_whose_smallest_hash_is_an_unrelated_set(spark, monkeypatch):
    monkeypatch.setattr(jj, "GROUP", 2000)
    monkeypatch.setattr(jj, "BLOCK", 700)
    monkeypatch.setattr(jj, "SMALL", 4)
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioubcd") for _ in range(8))
    passage, base = [word() for _ in range(60)], [word() for _ in range(20)]
    near = [" ".join([*base, *passage, word()]) for _ in range(60)]
    # Texts that share only the passage; the one of 4,000 with the smallest hash goes with 59 others.
    others = [" ".join([*(word() for _ in range(20)), *passage]) for _ in range(4000)]
    hashes = jj.set_keys(*jj.shingle_sets(pa.array(others), 5))[:, 0]
    assert hashes.min() < jj.set_keys(*jj.shingle_sets(pa.array(near), 5))[:, 0].min()
    rows = list(enumerate(near + [others[int(hashes.argmin())]] + others[:59]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute(rows)


def clouds(seed, n, off, shared=250):
    """Sets around a few bases, at about the distance where links begin and end."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = np.random.default_rng(seed * 100 + int(r.integers(0, 5))).integers(0, 1 << 60, 150)
        own = base.copy()
        own[r.integers(0, 150, int(r.integers(0, off)))] = r.integers(0, 1 << 60)
        own[: int(r.integers(0, off))] = r.integers(0, 1 << 60, 1)
        # What all share keeps the bases near each other, so that windows reach over the borders of regions.
        rows.append(np.unique(np.concatenate([own, np.arange(shared)])).astype(np.uint64))
    return [x.tobytes() for x in rows]


def all_pairs(rows):
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in rows]
    union = jj._Union(len(sets))
    for i, x in enumerate(sets):
        for j in range(i):
            if (common := len(x & sets[j])) * 5 >= 4 * (len(x) + len(sets[j]) - common):
                union.join(i, j)
    return union.roots().tolist()


@pytest.mark.parametrize("seed", range(4))
def test_regions_find_what_all_pairs_find(seed, monkeypatch):
    monkeypatch.setattr(jj, "LEAF", 6)
    rows = clouds(seed, 150, 60)
    assert jj.group_components(jj._Sets.of(rows)).tolist() == all_pairs(rows)


def test_windows_are_needed_and_regions_are_parted(monkeypatch):
    monkeypatch.setattr(jj, "LEAF", 6)
    rows = clouds(1, 150, 60, 20)
    calls, real = [], jj.join_region

    def counted(sets, names, home, union):
        calls.append(len(names))
        return real(sets, names, home, union)

    monkeypatch.setattr(jj, "join_region", counted)
    want = all_pairs(rows)
    assert jj.group_components(jj._Sets.of(rows)).tolist() == want
    assert len(calls) > 3 and max(calls[1:]) < len(rows)
    # Without the copies at the borders, links between regions are lost.
    lost = 0
    for seed in range(12):
        rows = clouds(seed, 150, 60)
        sets = jj._Sets.of(rows)
        distances, _ = sets.from_pivots([sets.get(p) for p in jj.choose_pivots(sets)])
        nearest, window = jj.windows(distances)
        for i, j in sets.links(np.arange(150), np.arange(150)):
            assert window[i, nearest[j]].all()
            lost += int((nearest[i] != nearest[j]).sum())
    assert lost > 0


@pytest.mark.parametrize("levels", [0, 6])
def test_groups_over_the_cluster_agree_with_all_pairs(spark, monkeypatch, levels):
    monkeypatch.setattr(jj, "GROUP", 6000)
    monkeypatch.setattr(jj, "BLOCK", 3000)
    monkeypatch.setattr(jj, "LEAF", 6)
    monkeypatch.setattr(jj, "LEVELS", levels)
    rows = list(dict.fromkeys(clouds(2, 150, 60)))
    members = [(i, i + 1, 0, len(x) // 8, 0, 0, 0, x) for i, x in enumerate(rows)]
    table = spark.createDataFrame(members, "id long, k1 long, k2 long, n long, component long, weight long, members long, shingles binary")
    got = {r.k1 - 1: r.low for r in jj._large_groups(table).collect()}
    assert [got[i] for i in range(len(rows))] == all_pairs(rows)


def test_chosen_documents_are_found_by_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_ROWS", 0)
    rows = list(enumerate(made(5, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute(rows)


def test_a_very_long_text(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10_000)}" for _ in range(60_000)]
    rows = [(2, " ".join(words)), (1, " ".join([*words, "end"])), (3, " ".join(words[:30_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute(rows)

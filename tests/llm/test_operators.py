"""Each operator on rows with nulls, empty and long texts, ties, repeats, clashing names, and on no rows."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pytest.importorskip("notewell.llm")
from notewell.llm import byte_bpe, license_scan, line_templates, multi_index, quality_rules, queries, source_mix, support, textcodes, token_counts, token_files, warc

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t", "a", "don't we'll I'VE 'sup ''s x's", "é½Ⅷ²漢字😀 <|endoftext|> </s><unk>▁ ▁▁x", "  two  blanks \n\n lines\r\n", "x" * 3000,
    "word " * 700, "\x00\x1c\x85\xa0", "one line\none line\none line", "Licensed under the Apache License, Version 2.0.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], 7, 8, 9) for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "en", "s1", 7, 8, 9), (None, "no key here", "en", "s1", 7, 8, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, size int, ids int")


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(3000))
    assert table.slot(b"other") == -1 and byte_bpe.MinimalPerfectHash([]).slot(b"a") == -1


def test_bpe_agrees_with_the_library(docs, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = P.path("byte_bpe_50k.tiktoken")
    want = []
    for key, text in texts(docs):
        ids = library.encode_ordinary(text)
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert ordered(byte_bpe.round_trip(docs, path).collect()) == ordered(want)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path), path)
    assert ordered((k, bytes(b).decode()) for k, b in decoded.collect()) == ordered(texts(docs))
    assert byte_bpe.round_trip(docs.limit(0), path).count() == 0


def test_pretokens_agree_with_the_pattern():
    import regex

    draw = random.Random(3)
    signs = list("ab sStTrRveelldm'''  \n\n\t\r  é1½²Ⅷ漢!?.-_\x1c\x85") + ["'s", "'ll", "'re", " '"]
    made = ["".join(draw.choice(signs) for _ in range(draw.randrange(0, 40))) for _ in range(3000)]
    codes, offsets = textcodes.code_points(made)
    starts = textcodes.pretokens(codes, offsets)
    joined, ends = "".join(made), np.append(starts[1:], len(codes))
    assert [joined[a:b] for a, b in zip(starts, ends, strict=True)] == [t for m in made for t in regex.findall(P.PATTERN, m)]


def test_counts_agree_with_the_library(docs, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(k, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 500) for k, t in texts(docs)]
    assert ordered(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), 500).collect()) == ordered(want)
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model"), 500).count() == 0


def test_files_give_back_all_ids(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for key, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert ordered(token_files.through_files(docs, P.path("byte_bpe_50k.json"), 2).collect()) == ordered(want)
    assert token_files.through_files(docs.limit(0), P.path("byte_bpe_50k.json"), 2).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(0, 90000, 7)), sorted(random.Random(1).choices(range(1 << 40), k=3000))])
def test_elias_fano(values):
    made = token_files.EliasFano.of(np.array(values, np.int64))
    coded = token_files.EliasFano.load(made.dump() + b"rest", made.sizes())
    assert [coded.select(i) for i in range(0, len(values), 37)] == values[::37]
    if len(values) > 600:
        assert coded.stretch(511, 80).tolist() == values[511:591] and len(made.dump()) < 8 * len(values)


def test_select_reads_a_small_part_of_the_index():
    values = np.cumsum(np.random.default_rng(2).integers(1, 5000, 400_000))
    made = token_files.EliasFano.of(values)
    read = []

    class File(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    raw = made.dump()
    coded = token_files.EliasFano.open(File(b"head" + raw), 4, made.sizes())
    assert not read and [coded.select(i) for i in (0, 123_456, 399_999)] == values[[0, 123_456, 399_999]].tolist()
    assert sum(read) < len(raw) // 20 and len(raw) < 8 * len(values) // 4


def test_shards_are_bounded_and_repeated_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    monkeypatch.setattr(token_files, "READ_IDS", 100)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(7 if i % 3 else i, f"text number {i} " * (i % 50), 1) for i in range(400)] + [(None, "x", 2), (-5, "y" * 100_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    folder = support.fresh_path(spark, "shards")
    encoded = token_files.encoded(docs, P.path("byte_bpe_50k.json"))
    bounds, nulls = token_files.ranges_of(docs, "doc_id", 8)
    assert len(bounds) == 7 and bounds.count(7) >= 4 and nulls == 1
    manifest = token_files.write_shards(encoded, (bounds, nulls), folder, 2, 2).collect()
    assert len(manifest) >= 8 and sum(r.n_docs for r in manifest) == 402 and max(r.n_docs for r in manifest) < 150
    got = token_files.through_files(docs, P.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    sums = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert ordered((r.doc_id, r.ids_crc32) for r in got) == ordered((k, sums(t)) for k, t, _ in rows)


def test_a_small_cache_gives_the_same_ids(docs, ranks, monkeypatch):
    from notewell.llm import pieces

    monkeypatch.setattr(pieces.PieceEncoder, "YOUNG", 50)
    draw = random.Random(4)
    codec = byte_bpe.Codec(ranks)
    small, large = pieces.PieceEncoder(codec.encode_pieces, codec.dtype, 120), pieces.PieceEncoder(codec.encode_pieces, codec.dtype, 100_000)
    for _ in range(40):
        made = [" ".join("".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 6))) for _ in range(60)) for _ in range(3)]
        for one, two in zip(small(made), large(made), strict=True):
            assert one.tolist() == two.tolist()
    assert len(small.old.hashes) <= 120


def test_nearest_agree_with_all_rows(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [0.0] * 8), (304, [float("nan")] * 8), (305, [None] * 8), (306, rows[7][1][:7] + [None]), (307, []), (7, rows[7][1]), (20, rows[20][1]), (None, rows[1][1])]
    table = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in multi_index.search(table, 20, reach=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and i < 302]
    assert sorted(got) == list(range(0, 301, 20))
    for i in range(0, 301, 20):
        v = good[i][1]
        want = sorted(((-sum(float(x) * float(y) for x, y in zip(v, w, strict=True)), j) for j, w in good if j != i))[:20]
        assert [(r, j) for r, j, _ in sorted(got[i])] == [(n + 1, j) for n, (_, j) in enumerate(want)]
        assert [s for _, _, s in sorted(got[i])] == pytest.approx([-s for s, _ in want], abs=1e-12)
    assert multi_index.search(table.limit(0), 20).count() == 0
    few = {(r.query_id, r.vec_id) for r in multi_index.search(table.where("vec_id in (0, 20, 21)"), 20).collect()}
    assert few == {(0, 20), (0, 21), (20, 0), (20, 21)}
    with pytest.raises(ValueError):
        multi_index.search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), 1)


@pytest.mark.parametrize("spread", [0.0, 0.3, 0.7])
def test_recall_where_the_index_prunes(spark, spread):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(12_000, 64))
    x *= (np.exp(spread * draw.normal(size=len(x))) / np.linalg.norm(x, axis=1))[:, None]
    x[5_000:5_400] = x[77]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(table, 100).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert sorted(got) == list(range(0, 12_000, 100))
    right = 0
    for q, found in got.items():
        products = x @ x[q]
        products[q] = -np.inf
        least = np.sort(products)[-20]
        assert len(found) == 20 and all(s == pytest.approx(products[i]) for i, s in found.items())
        right += sum(s >= least - 1e-12 for s in found.values())
    assert right >= 0.9 * 20 * len(got)


@pytest.mark.parametrize(("centres", "most"), [(0, 0.5), (200, 0.1)])
def test_only_visited_cells_are_multiplied(centres, most):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(8_000, 32))
    if centres:
        x = draw.normal(size=(centres, 32))[draw.integers(0, centres, len(x))] + 0.3 * x
    books = (multi_index.Book(x[:, :16], 64, 1), multi_index.Book(x[:, 16:], 64, 2))
    reach = multi_index.measured_reach(x, books, 20)
    i, j = books[0].assign(x[:, :16]), books[1].assign(x[:, 16:])
    sizes = np.zeros((64, 64), np.int64)
    np.add.at(sizes, (i, j), 1)
    asked = x[::40]
    one, two = books[0].far(asked[:, :16]), books[1].far(asked[:, 16:])
    cutoff = np.array([multi_index.traverse(a, b, sizes, int(np.ceil(reach * len(x)))) for a, b in zip(one, two, strict=True)])
    made, found = 0, np.full((len(asked), len(x)), -np.inf)
    for a in range(64):
        rows = np.flatnonzero(i == a)
        rows = rows[np.argsort(j[rows], kind="stable")]
        out, n = multi_index.products(asked, x[rows], j[rows], one[:, [a]] + two <= cutoff[:, None])
        found[:, rows] = out
        made += n
    assert made <= (reach * len(x) + sizes.max()) * len(asked) and reach <= most
    true = asked @ x.T
    assert np.allclose(found[found > -np.inf], true[found > -np.inf])
    # Each query finds itself; the reach was measured for the others.
    met = [len({*np.argsort(-t)[1:21]} & {*np.flatnonzero(f > -np.inf)}) for t, f in zip(true, found, strict=True)]
    assert sum(met) >= 0.92 * 20 * len(asked)


def test_traverse_visits_in_order_of_summed_distance():
    draw = np.random.default_rng(1)
    one, two, sizes = draw.random(6), draw.random(7), draw.integers(0, 5, (6, 7))
    cells = sorted((one[i] + two[j], sizes[i, j]) for i in range(6) for j in range(7))
    for enough in (1, 20, 60):
        total, last = 0, 0.0
        for last, n in cells:
            total += n
            if total >= enough:
                break
        assert multi_index.traverse(one, two, sizes, enough) == pytest.approx(last)


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(-1, None, "en", None, 0), (-2, "a b c", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = source_mix.mix(docs).collect()
    assert ordered(rows) == ordered(source_mix.mix(docs).collect())
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stops: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stops)
        want = {s: 2 * sizes[s] if s in stops else left * weight[s] / sum(weight[x] for x in names if x not in stops) for s in names}
        if not (more := {s for s in names if s not in stops and want[s] > 2 * sizes[s] + 1e-9}):
            break
        stops |= more
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= source_mix.BLOCK
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    votes = [53, 24, 23, 7, 1, 0]
    parts = spark.createDataFrame([("g", f"p{i}", float(v), 15) for i, v in enumerate(votes)], "g string, p string, v double, seats long")
    bids = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(15)))[:15]
    want = Counter(i for _, i in bids)
    assert {r.p: r.quota for r in source_mix.apportion(parts, ["g"], "p", "v", "seats").collect()} == {f"p{i}": want[i] for i in range(6)}


def test_quality_counts(docs):
    def brute(text):
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed

    got = quality_rules.judge(docs)
    assert ordered(tuple(r)[:7] for r in got.collect()) == ordered((k, *brute(t)) for k, t in texts(docs))
    assert got.where("base_failed and kept").count() == 0 and quality_rules.judge(docs.limit(0)).count() == 0


def test_mix_of_many_sources_odd_rows_and_clashing_names(spark):
    rows = [(i % 90 or None, "w " * (i % 7), f"s{i % 40:02}" if i % 40 else None, 5, "x") for i in range(300)] + [(1, "a b", "s01", 5, "x")] * 5 + [(2, "long " * 50_000, "s02", 5, "x"), (3, "", "only empty", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")
    got = source_mix.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = dict.fromkeys(names, 0.0)
    free = set(names)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in names if s not in free)
        want = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 2 * sizes[s] for s in names}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((r[1] or "").split()) for r in rows)
    assert all(target[s] == pytest.approx(want[s]) for s in names)
    # All quotients ranked in plain Python give the blocks; a source of one shard takes them, or twice itself at most.
    seats = round(sum(want.values()) / source_mix.BLOCK)
    bids = sorted((-want[s] / (2 * k + 1), i) for i, s in enumerate(names) for k in range(int(want[s] / source_mix.BLOCK) + 40))[:seats]
    quota = Counter(i for _, i in bids)
    assert {s: taken[s] for s in names} == {s: min(quota[i] * source_mix.BLOCK, 2 * sizes[s]) for i, s in enumerate(names)}


def test_ranges_count_like_one_window(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(50), i, float(draw.randrange(9))) for i in range(500)]
    table = spark.createDataFrame(rows, "g string, x int, i int, v double")
    got = {r.i: (r._n, r._upto_v) for r in source_mix.in_order(table, ["g"], [F.desc("x"), F.col("i").asc()], ["v"]).collect()}
    for g in ("a", "b", None):
        total = 0.0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            total += r[3]
            assert got[r[2]] == (n + 1, total)


def test_verdicts_agree_with_plain_python(spark):
    """Every distance, share and limit of the method's verdict, computed anew from the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    own = spark.createDataFrame([(9001, "x y z " * 80, None), (9002, "the of and to in is was for on with are that " * 9, ""), (9003, None, "en"), (9004, "", "xx")], "doc_id long, text string, lang string")
    docs = docs.union(own)
    rows = docs.collect()
    classes = [re.compile(f"[{c}]") for c in quality_rules.CLASSES]
    every = list(dict.fromkeys(w for ws in quality_rules.COMMON.values() for w in ws))
    base, ref = {}, {}
    for r in rows:
        text = r.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        chars = re.sub("[\x20\x09-\x0d]", "", text)
        hist = [len(c.findall(chars)) for c in classes]
        hist.append(len(chars) - sum(hist))
        listed = quality_rules.COMMON.get(r.lang, every)
        common = [words.count(w) for w in listed]
        base[r.doc_id] = failed, len(words), hist, common, r.lang
        if not failed:
            one = ref.setdefault(r.lang, [0, [0] * len(hist), [0] * len(common)])
            one[0] += len(words)
            one[1] = [a + b for a, b in zip(one[1], hist, strict=True)]
            one[2] = [a + b for a, b in zip(one[2], common, strict=True)]

    def far(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    Q = quality_rules
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    seen = Counter()
    for key, (failed, n, hist, common, lang) in base.items():
        words, chars, listed = ref.get(lang, (0, [0], [0]))
        js = [None] * 3
        if words >= Q.LEAST_REFERENCE:
            if sum(hist) >= Q.LEAST_CHARS:
                js[0] = far(hist, chars)
            if sum(common) >= Q.LEAST_COMMON and sum(listed):
                js[1] = far(common, listed)
            if n >= Q.MIN_WORDS:
                js[2] = far([sum(common), n - sum(common)], [sum(listed), words - sum(listed)])
        over = [x is not None and x > limit for x, limit in zip(js, (Q.LIMIT_CLASSES, Q.LIMIT_WORDS, Q.LIMIT_SHARE), strict=True)]
        r = got[key]
        assert (r.base_failed, r.kept) == (failed, not failed and not any(over))
        for x, y in zip(js, (r.js_classes, r.js_words, r.js_share), strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9))
        seen[failed, r.kept] += 1
    assert seen[False, True] > 50 and seen[True, False] > 5


def test_distance_of_histograms(spark):
    one = spark.sql("select array(1L, 3L, 0L) as p, array(2L, 0L, 2L) as q, 4d as p_n, 4d as q_n, 0d as zero")
    got = one.select(quality_rules._distance("p", "q", "p_n", "q_n").alias("d"), quality_rules._distance("p", "q", "p_n", "zero").alias("n")).first()
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0, 0.5])
    m = (p + q) / 2
    js = sum(x * math.log2(x / y) for x, y in zip(p, m, strict=True) if x) / 2 + sum(x * math.log2(x / y) for x, y in zip(q, m, strict=True) if x) / 2
    assert got.d == pytest.approx(math.sqrt(js)) and got.n is None


def test_long_texts_without_function_words_are_far_from_their_language(spark):
    draw = random.Random(2)
    own = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    plain = lambda n: " ".join(draw.choice(quality_rules.COMMON["en"]) if i % 5 == 0 else own() for i in range(n))
    rows = [(i, plain(200), "en") for i in range(30)] + [(30, plain(60), "en")]
    rows += [(40, " ".join(own() for _ in range(400)), "en"), (41, " ".join(own() for _ in range(60)), "en"), (42, " ".join(["in", *(own() for _ in range(59))] * 2), "en")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(31)) and not got[40].base_failed and not got[41].base_failed
    assert not got[40].kept and not got[41].kept and not got[42].kept and got[40].js_words is None


def test_recurring_templates_stay_once(spark):
    line = "Printed on day {} by user{}"
    rows = [(i, f"own words of document number{'abcdef'[i]}\n{line.format(i, i * 7)}\nlast one", 1) for i in range(6)] + [(9, None, 1), (10, "", 1), (None, line.format(1, 2), 1), (0, "own words of document numbera\n" + line.format(0, 0) + "\nlast one", 1)]
    out = line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"))
    got = ordered((r.doc_id, r.text, r.n_dropped) for r in out.collect())
    keeps = [x for x in got if x[1] and "Printed" in x[1]]
    assert len(keeps) == 1 and keeps[0][0] is None and (9, None, 0) in got and (10, "", 0) in got
    # One "last one" stays, in the first row, and of the first lines, which differ in one word, one; equal rows are alike.
    assert sum(x[1].count("last one") for x in got if x[1]) in (1, 2) and sum(x[1].count("own words") for x in got if x[1]) in (1, 2)
    assert line_templates.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dropped_places(spark, rows, **how):
    drops = line_templates.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    return {(r.id, p) for r in drops.collect() for p in r["drop"]}


def test_differing_tokens_become_fields_at_the_leaves(spark):
    names = ["alice", "bob", "carol", "dave"]
    posted = [(i, f"Posted by {x} in news\nOnly here {x}{x}") for i, x in enumerate(names)]
    # Four documents, one template; two documents alone are too few, and one document can't make a template.
    assert dropped_places(spark, posted) == {(1, 0), (2, 0), (3, 0)}
    assert dropped_places(spark, posted[:2]) == set()
    assert dropped_places(spark, [(5, "\n".join(f"Posted by {x} in news" for x in names))]) == set()
    # Rows of numbers have no constant token, so equal ones recur and others don't.
    numbers = [(i, f"{i}.1 4.{i} 9.2 {i * i}") for i in range(5)] + [(i, "7.5 7.5 7.5") for i in range(10, 13)]
    assert dropped_places(spark, numbers) == {(11, 0), (12, 0)}
    # Lines that agree in fewer than four of five tokens are no template.
    assert dropped_places(spark, [(i, f"The {a} {b} house stands") for i, (a, b) in enumerate(zip(names, names[1:] + names[:1], strict=True))]) == set()
    # Length and beginning part the tree: the same words in other places aren't compared.
    assert dropped_places(spark, [(0, "Posted by alice in news"), (1, "Posted by bob in news today"), (2, "Sent by carol in news")]) == set()


def test_lines_of_one_token_long_lines_and_short_ones(spark):
    one = [(i, f"Advertisement\n}}\n{'abc'[i]}" * 1) for i in range(3)]
    assert dropped_places(spark, one, min_chars=8) == {(1, 0), (2, 0)}
    assert dropped_places(spark, one) == {(1, 0), (2, 0), (1, 1), (2, 1)}
    passage = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i % 3]}" for i in range(60))
    other = " ".join("".join(chr(97 + (7 * i + 3 * j) % 26) for j in range(5)) for i in range(70))
    assert dropped_places(spark, [(0, "mine\n" + passage), (1, passage + "\n" + other)]) == {(1, 0)}
    # Copies may keep their lines, whichever is longer; a third document of them makes all lines recur.
    copies = [(0, passage + "\n" + other), (1, passage + "\n" + other)]
    assert dropped_places(spark, copies, keep_copies=True) == set() and dropped_places(spark, copies) == {(1, 0), (1, 1)}
    assert dropped_places(spark, [(None, passage), (1, passage)], keep_copies=True) == set() and dropped_places(spark, [(None, passage), (1, passage)]) == {(1, 0)}
    assert dropped_places(spark, [(None, passage), (1, passage + "\n" + other)], keep_copies=True) == {(1, 0)}
    assert dropped_places(spark, [(i, passage + "\n" + other) for i in range(3)], keep_copies=True) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert dropped_places(spark, [(0, " ".join(passage.split()[:20])), (1, " ".join(passage.split()[:20]))]) == set()


def test_longer_lines_vary_right_after_their_first_tokens(spark):
    names = ["ann", "bert", "carl", "dora", "emil"]
    rows = [(i, f"Posted by {name} in the big news of our town this week") for i, name in enumerate(names)]
    assert dropped_places(spark, rows) == {(i, 0) for i in range(1, 5)}
    base = duckdb.connect()
    base.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toArrow())
    assert base.execute(f"select sum(n_dropped) from ({line_templates.SQL})").fetchone()[0] == 4


def test_hot_templates_and_tokens_are_joined_by_themselves(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, f"Posted by u{draw.choice('abcdefgh')}{draw.choice('xyz')} in {draw.choice(['news', 'sport'])}\nAll rights are reserved\nown {'x' * (i + 9)}") for i in range(60)]
    want = dropped_places(spark, rows)
    assert sum(p == 1 for _, p in want) == 59 and any(p == 0 for _, p in want) and not any(p == 2 for _, p in want)
    monkeypatch.setattr(line_templates, "LEAST_HOT", 10)
    monkeypatch.setattr(line_templates, "HOT_LINES", 10)
    monkeypatch.setattr(line_templates, "HOT_TOKENS", 20)
    assert dropped_places(spark, rows) == want


def test_nodes_are_compared_in_a_task_and_over_the_cluster_alike(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, f"Posted by u{draw.choice('abcdefgh')}{draw.choice('xyz')} in {draw.choice(['news', 'sport'])}\nown {'x' * (i + 9)}\nSold to {draw.choice('abc')}{draw.choice('abc')} for {draw.choice('de')} dollars in town") for i in range(60)]
    want = dropped_places(spark, rows)
    assert any(p == 0 for _, p in want) and any(p == 2 for _, p in want)
    monkeypatch.setattr(line_templates, "NODE", 0)
    assert dropped_places(spark, rows) == want
    # With hot tokens, and with so few bits that nearly every row passes.
    for name, value in (("LEAST_HOT", 10), ("HOT_LINES", 10), ("HOT_TOKENS", 20), ("BITS", 64)):
        monkeypatch.setattr(line_templates, name, value)
    assert dropped_places(spark, rows) == want


@pytest.mark.parametrize("how", [{}, {"min_chars": 8, "keep_copies": True}])
def test_texts_of_documents_that_lose_nothing_are_not_shuffled(spark, monkeypatch, how):
    context = spark.sparkContext._jsc.sc()
    # As where tables are too large for Spark to broadcast them by itself.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(line_templates, "BROADCAST_ROWS", 0, raising=False)

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    draw = random.Random(5)
    rows = [(i, " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1000)) + ("\nAll rights are reserved" if i < 4 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled()
    try:
        line_templates.dedup(docs, **how).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert 0 < shuffled() - before < 1_000_000 < sum(len(t) for _, t in rows) / 3


def test_licenses_and_inheritance(spark, docs):
    files = [
        ("LICENSE", "Released under the MIT License.", True), ("a/LICENSE", "preamble\nLicensed under the Apache License, Version 2.0.\n", True), ("a/b/x", "no words of it", False), ("c/y", None, False), ("z", "", False),
        ("a/own", "text " * 50 + "\nThis work is licensed under the GNU General Public License, version 3.", False), ("ab/x", "licence of the version", False),
    ]
    rows = spark.createDataFrame(files, "path string, text string, is_license_file boolean")
    scanned = license_scan.scan(rows, "path", "text").join(rows.select("path", "is_license_file"), "path")
    got = {r.path: (r.license, r.inherited_from) for r in license_scan.inherit(scanned).collect()}
    assert got == {"LICENSE": ("MIT", None), "a/LICENSE": ("Apache-2.0", None), "a/b/x": ("Apache-2.0", "a/"), "c/y": ("MIT", "/"), "z": ("MIT", "/"), "a/own": ("GPL-3.0", None), "ab/x": ("MIT", "/")}
    assert license_scan.query(docs).count() == docs.count() and license_scan.query(docs.limit(0)).count() == 0


def test_the_bound_loses_no_license():
    import pyarrow as pa

    draw = random.Random(5)
    statements = [s for group in license_scan.TEMPLATES.values() for s in group]
    templates = license_scan.Templates(license_scan.TEMPLATES)
    made = []
    for _ in range(300):
        words = draw.choice(statements).split()
        for _ in range(draw.randrange(0, 8)):
            words[draw.randrange(len(words))] = draw.choice(["foo", "bar", "version", "the"])
        made.append(" ".join(words) + " baz" * draw.randrange(0, 9))
    names, scores = license_scan._scan_batch(pa.array(made), templates)
    for text, name, score in zip(made, names, scores, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        best, at = templates.best(license_scan.tokens(data, np.array([0, len(data)]))[3])
        assert (name, score) == ((templates.names[at], best) if best >= license_scan.LEAST else (None, 0.0))


def test_notices_in_paragraphs_and_wrapped_headers(spark):
    code = "\n".join(f"value_{i} = call_{i}(left, right)" for i in range(60))
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    isc = "Copyright (c) 2020\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED AS IS"
    texts = [gpl.format("") + code, gpl.format("Lesser ") + code, "An ordinary sentence stands before it here. Licensed under CC BY 4.0. Another one follows.", isc, "we are Licensed under CC BY", "4.0 " + code]
    files = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    got = {r.k: r.own_license for r in license_scan.scan(files, "k", "text").collect()}
    assert got == {0: "GPL-3.0", 1: "LGPL-3.0", 2: "CC-BY-4.0", 3: "ISC", 4: got[4], 5: None}


def test_windows_lose_no_license():
    import pyarrow as pa

    draw = random.Random(6)
    statements = [s for group in license_scan.TEMPLATES.values() for s in group]
    templates = license_scan.Templates(license_scan.TEMPLATES)
    made = []
    for _ in range(40):
        words = draw.choice(statements).split()
        for _ in range(draw.randrange(0, 12)):
            words[draw.randrange(len(words))] = draw.choice(["foo", "bar", "version", "the"])
        made.append(" ".join(["baz the"] * draw.randrange(0, 9) + words + ["of baz"] * draw.randrange(0, 9)).replace(" ", draw.choice([" ", "\n"])))
    lines, line_scores = license_scan._scan_batch(pa.array(made), templates)
    names, scores = license_scan._scan_batch(pa.array(made), templates, windows=True)
    for text, name, score, line, line_score in zip(made, names, scores, lines, line_scores, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes = license_scan.tokens(data, np.array([0, len(data)]))[3]
        best = max((templates.best(hashes[i : i + n])[0] for n in set(templates.lengths) for i in range(len(hashes) - n + 1)), default=0.0)
        # A window of one template's length may be nearest to another; the bound is on the template of its own length.
        assert score >= line_score and score <= max(best, line_score) + 1e-9
        own = max((float(templates.matrix[k] @ _unit(templates, hashes[i : i + n])) for k, n in enumerate(templates.lengths) for i in range(len(hashes) - n + 1)), default=0.0)
        assert score >= own - 1e-9 if own >= license_scan.LEAST else True
        assert (name is None) == (score == 0.0)


def test_scan_agrees_with_plain_cosines(spark):
    """Tokens, weights, cosines, lines, windows and whole texts computed anew, without hashes, bounds or matrices."""
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    named = [(name, split(x)) for name, group in license_scan.TEMPLATES.items() for x in group]
    df = Counter(t for _, ws in named for t in set(ws))
    weight = lambda t: math.log((1 + len(named)) / (1 + df.get(t, 0))) + 1

    def vector(ws):
        v = {t: n * weight(t) for t, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    vectors = [vector(ws) for _, ws in named]
    cosine = lambda v, k: sum(x * vectors[k].get(t, 0.0) for t, x in v.items())
    draw = random.Random(11)
    statements = [x for group in license_scan.TEMPLATES.values() for x in group]
    texts = [None, "", "licence", "the the the"]
    for _ in range(60):
        ws = draw.choice(statements).split()
        for _ in range(draw.randrange(0, 6)):
            ws[draw.randrange(len(ws))] = draw.choice(["foo", "version", "the", "naïve"])
        texts.append(draw.choice(["", "A sentence before. ", "x\n"]) + draw.choice([" ", "\n"]).join(ws) + draw.choice(["", " and after it", "\ny"]))
    got = {r.k: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text").collect()}
    seen = 0
    for i, text in enumerate(texts):
        tokens = split(text or "")
        units = [split(x) for x in (text or "").split("\n")] + [tokens]
        every = [(cosine(v, k), k) for v in map(vector, units) for k in range(len(named))]
        # A window is compared with the template of its own length at least, and with no more than all.
        windows = [(len(ws), vector(tokens[a : a + len(ws)])) for ws in {tuple(ws) for _, ws in named} for a in range(len(tokens) - len(ws) + 1)]
        least = max([c for c, _ in every] + [cosine(v, k) for n, v in windows for k in range(len(named)) if len(named[k][1]) == n], default=0.0)
        most = max([c for c, _ in every] + [cosine(v, k) for _, v in windows for k in range(len(named))], default=0.0)
        if least >= license_scan.LEAST:
            assert least - 1e-9 <= got[i].own_score <= most + 1e-9
            best = {named[k][0] for v in [vector(u) for u in units] + [v for _, v in windows] for k in range(len(named)) if cosine(v, k) >= got[i].own_score - 1e-9}
            assert got[i].own_license in best
            seen += 1
        elif most < license_scan.LEAST:
            assert got[i].own_license is None and got[i].own_score == 0.0
    assert seen > 40


def test_inheritance_agrees_with_a_walk_up_the_path(spark):
    draw = random.Random(12)
    rows = []
    for i in range(300):
        folder = "/".join(draw.choice("abc") for _ in range(draw.randrange(0, 4)))
        rows.append(((folder + "/" if folder else "") + f"f{i}", draw.random() < 0.2, draw.choice(["MIT", "ISC", None, None]), round(draw.random(), 1)))
    said: dict = {}
    for path, speaks, name, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if speaks and name:
            said.setdefault(path.rpartition("/")[0], name)

    def walk(path):
        folder = path.rpartition("/")[0]
        while folder and folder not in said:
            folder = folder.rpartition("/")[0]
        return said.get(folder), (folder + "/" if folder in said else None)

    table = spark.createDataFrame(rows, "path string, is_license_file boolean, own_license string, own_score double")
    for r in license_scan.inherit(table).collect():
        name, folder = walk(r.path)
        assert (r.license, r.inherited_from) == ((r.own_license, None) if r.own_license else (name, folder))


def _unit(templates, hashes):
    count = Counter(hashes.tolist())
    at = {h: i for i, h in enumerate(templates.vocabulary.tolist())}
    norm = math.sqrt(sum((n * (templates.idf[at[h]] if h in at else templates.rarest)) ** 2 for h, n in count.items()))
    out = np.zeros(len(at))
    for h, n in count.items():
        if h in at:
            out[at[h]] = n * templates.idf[at[h]] / norm
    return out


def test_archives_agree_with_sql(spark):
    long = "p" * 150
    rows = [(5, "u", long), (3, "v\r\nw", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    base = duckdb.connect()
    base.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = base.execute(f"select {', '.join(columns)} from ({warc.SQL})").fetchall()
    assert ordered(warc.through_archives(pages).select(columns).collect()) == ordered(want)
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_an_archive_of_another_attempt_is_never_read(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(20)], "page_id long, url string, html string")
    folder = support.fresh_path(spark, "warc")
    index = warc.write(warc.classified(pages), folder)
    # A second attempt over rows in another order leaves the committed index as it was.
    warc.write(warc.classified(pages).orderBy(F.desc("page_id")).coalesce(1), folder)
    assert ordered((r.page_id, bytes(r.payload).decode()) for r in warc.read(index, folder, with_payload=True).collect()) == ordered((i, f"page {i} " * 40) for i in range(20))


def test_pages_that_repeat_or_have_no_key(spark):
    long = "z" * 200_000
    rows = [(None, "u", long), (4, "u", long), (4, "u", long), (2, "u", long), (2, "v", "ü" * 60), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = ordered((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.through_archives(pages).collect())
    assert got == ordered([(None, 200_000, "response", None), (4, 200_000, "revisit", 2), (4, 200_000, "revisit", 2), (2, 200_000, "response", None), (2, 120, "response", None), (None, 0, "response", None)])


def test_archives_are_read_by_chosen_ranges(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(40)], "page_id long, url string, html string")
    folder = support.fresh_path(spark, "warc")
    index = warc.write(warc.classified(pages), folder)
    got = warc.read(index.where("url in ('u3', 'u30')"), folder, with_payload=True).collect()
    assert ordered((r.page_id, bytes(r.payload).decode()) for r in got) == [(3, "page 3 " * 40), (30, "page 30 " * 40)]
    assert list(warc.ranges([(0, 10), (10, 5), (1 << 20, 4)])) == [(0, 15, [0, 1]), (1 << 20, (1 << 20) + 4, [2])]


def test_line_query_agrees_with_sql(spark):
    base = duckdb.connect()
    draw = random.Random(9)
    word = lambda: draw.choice(["red", "blue", "one", "of", "the", "4", "x7", "house", "<*>"])
    made = [(i, "\n".join(draw.choice(["Posted by {0} in the {1} news", "{0}  {1} {2}", "Call {0}\tnow for {1} of the {2} offers", "{0}{1}{2}{0}{1}"]).format(word(), word(), word()) for _ in range(4))) for i in range(150)]
    made += [(900, None), (901, "")]
    for table in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.createDataFrame(made, "doc_id long, text string")):
        base.register("documents", table.toArrow())
        want = base.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_templates.SQL})").fetchall()
        got = line_templates.query(table).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        assert ordered(got) == ordered(want) and sum(r.n_dropped for r in got) > 100

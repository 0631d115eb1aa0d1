"""Ranked lexical search of all documents for many items at once: a join that is seeded with thresholds.

The score of a document for an item sums, over the item's terms, weight times impact; an impact depends on how often the
document has the term and on its length.  What is stored, restricted to the terms that items ask for:

* postings, a row a document: its length, its terms and how often it has each;
* a row a term: how many documents have it, its highest impact and its kth highest one.

1. Seed: k documents reach ``weight * kth impact`` of any one of an item's terms, so the largest of these products is a
   lower bound of the item's kth score.
2. Prune: an item's terms are ordered by the most that each can add.  The longest suffix whose sum stays below the seed
   can't bring a document into the result by itself: its terms make no candidates.
3. Candidates: postings of the other terms meet the items on the term, within a task; a document stays only if what it
   has there, and the suffix's bound, reach the threshold.  The kth best sum that a task has seen raises its threshold.
4. Rescore: candidates get their exact score over all terms in 64-bit integers.  A task sends k rows an item at most,
   which a window ranks.

Documents are never shuffled.  Items are taken in blocks of bounded size, each sent to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_scan import tokens
from .support import written
from .textcodes import equal_pieces, expand, piece_hashes, slices, utf8_column

#: Items and terms of a block; cells of a task's table of sums.
ITEMS, TERMS, CELLS = 2_000, 400_000, 1 << 21
#: Stands for a null key within tasks, so that it comes last among equal scores.
NO_KEY = (1 << 63) - 1


class Vocabulary:
    """The terms of a block of items, found by their hash and then compared."""

    def __init__(self, terms: list[str]):
        data = "".join(terms).encode("utf-8", "surrogatepass")
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in terms], np.int64)
        ends = np.cumsum(sizes)
        hashes = piece_hashes(np.frombuffer(data, np.uint8), ends - sizes, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.data = hashes[self.order], np.frombuffer(data, np.uint8)
        self.starts, self.sizes = (ends - sizes)[self.order], sizes[self.order]
        self.near = np.zeros(1 << 20, bool)
        self.near[hashes & np.uint64(0xFFFFF)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the tokens are terms, and which terms they are.  Terms whose hashes are equal stand side by side."""
        which = np.flatnonzero(self.near[hashes & np.uint64(0xFFFFF)])
        at = np.searchsorted(self.hashes, hashes[which])
        found, terms = [], []
        while len(which):
            fits = at < len(self.hashes)
            fits[fits] = self.hashes[at[fits]] == hashes[which[fits]]
            which, at = which[fits], at[fits]
            sizes = (ends - starts)[which]
            same = self.sizes[at] == sizes
            some = np.flatnonzero(same)
            same[some] = equal_pieces(data, starts[which[some]], self.data, self.starts[at[some]], sizes[some])
            found.append(which[same])
            terms.append(self.order[at[same]])
            which, at = which[~same], at[~same] + 1
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *terms])


def terms_of(texts: list[str | None]) -> list[Counter[str]]:
    """The terms of each text and how often it has them."""
    data, offsets = utf8_column(pa.array(texts, pa.large_string()))
    data, starts, ends, _ = tokens(data, offsets)
    raw = data.tobytes()
    bounds = np.searchsorted(starts, offsets)
    return [Counter(raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def postings(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of each document with a term of any kind: all of its terms counted, those in ``terms`` listed."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))
    width = max(1, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, offsets = utf8_column(batch.column(1).slice(a, b - a))
                data, starts, ends, hashes = tokens(data, offsets)
                n = np.diff(np.searchsorted(starts, offsets))
                at, term = shared.value.find(data, starts, ends, hashes)
                doc = np.searchsorted(offsets, starts[at], "right") - 1
                pair, tf = np.unique(doc * width + term, return_counts=True)
                upto = np.searchsorted(pair // width, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(x.astype(np.int32))) for x in (pair % width, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def _impacts(n: np.ndarray, tf: np.ndarray, docs: int, words: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * docs) // words
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _lists(batch: pa.RecordBatch, docs: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (its place in the batch), term and impact of each posting."""
    sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(batch)), sizes)
    term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    return doc, term, _impacts(batch.column(1).to_numpy()[doc], tf, docs, words)


def _first(group: np.ndarray, *worse: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group, in the order of ``worse``."""
    order = np.lexsort((*reversed(worse), group))
    ordered = group[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < k]


def term_table(stored: DataFrame, k: int, docs: int, words: int, n_terms: int) -> DataFrame:
    """(term, df, top, kth) of each term that occurs: kth is the kth highest impact, 0 if fewer than k documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        terms, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, term, impact = _lists(batch, docs, words)
            df += np.bincount(term, minlength=n_terms)
            terms, best = np.concatenate([terms, term]), np.concatenate([best, impact])
            kept = _first(terms, -best, k=k)
            terms, best = terms[kept], best[kept]
        # A document frequency comes with the first of a task's impacts of the term.
        first = np.concatenate([[True], terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(best), pa.array(np.where(first, df[terms], 0))], ["term", "impact", "df"])

    rows = stored.mapInArrow(run, "term int, impact long, df long")
    frequency = rows.groupBy("term").agg(F.sum("df").alias("df"), F.max("impact").alias("top"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    kth = rows.select("term", "impact", place.alias("place")).where(F.col("place") <= k).where(F.col("place") == k).select("term", F.col("impact").alias("kth"))
    return frequency.join(kth, "term", "left").select("term", "df", "top", F.coalesce("kth", F.lit(0)).alias("kth"))


class Plan:
    """What a block of items asks of its terms: weights, seeds, the terms that make candidates, and the bound of the others."""

    def __init__(self, items: list[dict[int, int]], weight: np.ndarray, top: np.ndarray, kth: np.ndarray):
        self.n_terms, self.n_items = len(weight), len(items)
        self.seed, self.rest = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        every: list[tuple[np.ndarray, np.ndarray]] = []
        essential: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, item in enumerate(items):
            terms = np.array(list(item), np.int64)
            factor = np.array(list(item.values()), np.int64) * weight[terms]
            some = factor * top[terms] > 0
            terms, factor = terms[some], factor[some]
            most = factor * top[terms]
            order = np.argsort(-most, kind="stable")
            terms, factor, most = terms[order], factor[order], most[order]
            self.seed[i] = (factor * kth[terms]).max(initial=0)
            # suffix[j]: what the terms from j on add at most.
            suffix = np.append(np.cumsum(most[::-1])[::-1], 0)
            cut = int(np.searchsorted(-suffix, -self.seed[i], "right"))
            cut = min(max(cut, 1), len(terms))
            self.rest[i] = suffix[cut]
            every.append((terms, factor))
            essential.append((terms[:cut], np.full(cut, i, np.int64), factor[:cut]))
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t, _ in every])]).astype(np.int64)
        self.terms, self.factors = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*every, strict=True))
        term, self.item, self.factor = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*essential, strict=True))
        order = np.argsort(term, kind="stable")
        self.item, self.factor = self.item[order], self.factor[order].astype(np.float64)
        self.of_term = np.searchsorted(term[order], np.arange(self.n_terms + 1))

    def rescore(self, doc: np.ndarray, item: np.ndarray, postings: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores of pairs; ``postings`` are the sorted document * n_terms + term of the batch."""
        counts = self.begin[item + 1] - self.begin[item]
        at = expand(self.begin[item], counts)
        asked = np.repeat(doc, counts) * self.n_terms + self.terms[at]
        place = np.minimum(np.searchsorted(postings, asked), len(postings) - 1)
        part = np.where(postings[place] == asked, self.factors[at] * impact[place], 0)
        return np.add.reduceat(part, np.cumsum(counts) - counts) if len(part) else np.zeros(len(doc), np.int64)


def _scored(stored: DataFrame, plan: Plan, k: int, docs: int, words: int) -> DataFrame:
    """(item, id, score): of each task the k best documents of each item, among which are all that belong in the result."""
    shared = stored.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        least = plan.seed.copy()
        items, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, CELLS // max(1, plan.n_items))
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                doc, term, impact = _lists(batch, docs, words)
                counts = plan.of_term[term + 1] - plan.of_term[term]
                at = expand(plan.of_term[term], counts)
                if not len(at):
                    continue
                cell = np.repeat(doc, counts) * plan.n_items + plan.item[at]
                sums = np.bincount(cell, plan.factor[at] * np.repeat(impact, counts), len(batch) * plan.n_items).reshape(len(batch), -1)
                threshold = least.astype(np.float64)
                if len(batch) >= k:
                    threshold = np.maximum(threshold, np.partition(sums, len(batch) - k, 0)[len(batch) - k] * (1 - 1e-12))
                d, i = np.nonzero((sums > 0) & ((sums + plan.rest) * (1 + 1e-12) >= threshold))
                # A posting's document and term ascend, since a document's terms do.
                named = doc * plan.n_terms + term
                for a in range(0, len(d), 1 << 16):
                    some, which = d[a : a + (1 << 16)], i[a : a + (1 << 16)]
                    exact = plan.rescore(some, which, named, impact)
                    fine = (exact > 0) & (exact >= least[which])
                    keys = batch.column(0).fill_null(NO_KEY).to_numpy()[some[fine]]
                    items, ids, scores = np.concatenate([items, which[fine]]), np.concatenate([ids, keys]), np.concatenate([scores, exact[fine]])
                    kept = _first(items, -scores, ids, k=k)
                    items, ids, scores = items[kept], ids[kept], scores[kept]
                    last = np.flatnonzero(np.bincount(items, minlength=plan.n_items) == k)
                    least[last] = np.maximum(least[last], scores[np.searchsorted(items, last, "right") - 1])
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(scores)], ["item", "id", "score"])

    return stored.mapInArrow(run, "item long, id long, score long")


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[Counter[str]]]]:
    """Keys and terms of the items, block by block."""
    keys, found, size = [], [], 0
    for key, text in items.toLocalIterator():
        (terms,) = terms_of([text])
        if found and (len(found) >= ITEMS or size + len(terms) > TERMS):
            yield keys, found
            keys, found, size = [], [], 0
        if terms:
            keys.append(key)
            found.append(terms)
            size += len(terms)
    if found:
        yield keys, found


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, of equal scores the smaller doc_id.

    Documents and items without a term (null and empty texts among them) take no part, nor do documents with score 0.
    Keys of documents are read as long; documents without one are ranked after others of the same score, and rows that
    repeat a key are documents each.  Of items that repeat a key, null keys among them, the smallest text asks.  Other
    columns are left out; an empty table of either kind gives an empty result.
    """
    spark = docs.sparkSession
    schema = f"{item_key} {items.schema[item_key].dataType.simpleString()}, rank int, {key} long, score long"
    asked = items.groupBy(item_key).agg(F.min(item_text).alias("_text")).select(item_key, "_text")
    out = spark.createDataFrame([], schema)
    for keys, found in _blocks(asked):
        vocabulary = sorted(set().union(*found))
        place = {t: i for i, t in enumerate(vocabulary)}
        stored = written(postings(docs, vocabulary, key, text), "postings")
        n_docs, words = stored.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df, top, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
        for r in term_table(stored, k, n_docs, words, len(vocabulary)).collect():
            df[r.term], top[r.term], kth[r.term] = r.df, r.top, r.kth
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        plan = Plan([{place[t]: n for t, n in item.items()} for item in found], weight, top, kth)
        scored = _scored(stored, plan, k, n_docs, words)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], f"item long, {item_key} {items.schema[item_key].dataType.simpleString()}")
        ranked = ranked.join(F.broadcast(names), "item").select(item_key, "rank", F.when(F.col("id") != NO_KEY, F.col("id")).alias(key), "score")
        out = out.union(ranked)
    return out


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents where text is not null),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from benchmark where text is not null),
q as (select item_id, t, count(*) as q from (select item_id, unnest(ts) as t from i) group by all),
all_docs as (select count(*) as n_docs, sum(len(ts))::bigint as words from d where len(ts) > 0),
p as (select doc_id, n, t, count(*) as tf from (select doc_id, len(ts)::bigint as n, unnest(ts) as t from d) where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, all_docs group by t, n_docs),
s as (
  select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // words))))::bigint as score
  from p join w using (t) join q using (t), all_docs group by item_id, doc_id)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= 20
"""

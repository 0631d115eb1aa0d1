"""Quality rules for documents: repetition and length counts, then the divergence from language references.

All of it is column expressions; a document is judged within its own row, but for the references, which are sums
over all documents of a language.  A reference has three histograms: classes of characters, the most common function
words of the language, and those words against all others.  A document that passes the base rules is rejected if the
Jensen-Shannon distance of any of them to its language's reference is above a limit; the guards leave out documents
too short for a histogram to mean something, and languages with too little text for a reference.  The share of common
words is compared for every document with MIN_WORDS words, so a text with few or none of them is far from its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import BLANKS, WORD, written

#: Common function words of each language.
COMMON = {
    "en": ["the", "of", "to", "and", "in", "that", "is", "was", "for", "on", "are", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Classes of characters; what is in none of them is the last class, white space left out.
CLASSES = [r"a-z", r"A-Z", r"0-9", r".,;:!?'\"()\-", r"#*$%&|<>"]
LIMIT_CLASSES, LIMIT_WORDS = 0.3, 0.6
#: Limit on the distance of the shares of common and other words; of a reference of 16 %, less than 3 % or over 37 %.
LIMIT_SHARE = 0.2
#: Characters and common words that a document must have to be compared, and words that a reference must have.
LEAST_CHARS, LEAST_COMMON, LEAST_REFERENCE = 200, 30, 2000
MIN_WORDS = 50
#: Languages up to which their references (about 400 bytes each) are broadcast.
BROADCAST_ROWS = 10_000


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common, row) of each row; row holds the columns of ``carry``."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), t.alias("t"), F.struct(*carry or [F.lit(0).alias("none")]).alias("row"))
    base = base.withColumn("words", F.filter(F.split("t", BLANKS), lambda w: w != ""))
    # Three words in a row as one hash; a window of the text is its place in this array.
    base = base.withColumn("h", F.when(F.size("words") >= 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")).otherwise(F.expr("cast(array() as array<bigint>)")))
    # Hashes in order bring equal windows together; only texts that have some sort their windows with the places.
    base = base.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.expr("transform(h, (x, i) -> struct(x as x, i as i))"))).otherwise(F.expr("cast(array() as array<struct<x:bigint,i:int>>)")))
    base = base.withColumn("at", F.sort_array(F.expr("transform(filter(sorted, (p, k) -> p.x = get(sorted, k - 1).x or p.x = get(sorted, k + 1).x), p -> p.i)")))
    # Each such window covers its three words, less those that the next one covers too.
    repeat = F.expr("aggregate(at, struct(0L as n, -3 as last), (s, i) -> struct(s.n + least(3, i - s.last) as n, i as last), s -> s.n)")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    base = base.withColumn("lines", lines)
    # Lower-case runs go together with the blanks between them, in few long matches; each class after that is
    # taken from the little that is left.
    base = base.withColumn("chars", F.length(F.array_join("words", "")).cast("long"))
    left = "t"
    for i, c in enumerate(CLASSES):
        base = base.withColumn(f"left_{i}", F.regexp_replace(left, f"[{c}{' ' + BLANKS[1:-2] if i == 0 else ''}]+", ""))
        left = f"left_{i}"
    lengths = [F.col("chars"), *[F.length(f"left_{i}").cast("long") for i in range(len(CLASSES))]]
    symbols = [a - b for a, b in zip(lengths, lengths[1:], strict=False)]
    spoken = F.filter("words", lambda w: F.array_contains(_words_of(F.col("lang")), w))
    base = base.withColumn("spoken", spoken).withColumn("classes", F.array(*symbols, lengths[-1]))
    return base.select(
        F.col("id").alias(key),
        F.col("lang").alias("lang"),
        F.size("words").cast("long").alias("n_words"),
        F.col("chars").alias("word_chars"),
        F.col("classes")[len(CLASSES) - 1].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.col("classes"),
        F.transform(_words_of(F.col("lang")), lambda c: F.size(F.filter(F.col("spoken"), lambda w: w == c)).cast("long")).alias("common"),
        F.col("row"),
    )


def _words_of(lang: Column) -> Column:
    """The list of common words of a language; of an unknown one, that of all."""
    every = F.array(*[F.lit(w) for w in dict.fromkeys(w for words in COMMON.values() for w in words)])
    out = every
    for name, words in COMMON.items():
        out = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def _distance(p: str, q: str, p_total: str, q_total: str) -> Column:
    """The Jensen-Shannon distance, to base 2, of two histograms of equal length (null if one is empty)."""
    # A total of zero must not be divided by, whichever branch is evaluated first.
    x, y = f"a / nullif({p_total}, 0d)", f"b / nullif({q_total}, 0d)"
    term = lambda own: f"case when {own[0]} > 0 then {own} * log2({own} / (({x} + {y}) / 2)) else 0d end"
    terms = f"aggregate(zip_with({p}, {q}, (a, b) -> ({term(x)} + {term(y)}) / 2), 0d, (s, x) -> s + x)"
    return F.expr(f"case when {p_total} > 0 and {q_total} > 0 then sqrt(greatest(0d, {terms})) end")


def references(counted: DataFrame) -> DataFrame:
    """(lang, reference sums): the histograms of all documents of a language that pass the base rules, added up."""
    most = max(len(CLASSES) + 1, sum(map(len, COMMON.values())))
    sums = [F.sum(F.when(~F.col("base_failed"), F.get(c, F.lit(i)))).alias(f"{c}_{i}") for c in ("classes", "common") for i in range(most)]
    summed = counted.groupBy("lang").agg(F.sum(F.when(~F.col("base_failed"), F.col("n_words"))).alias("ref_words"), *sums)
    lists = [F.filter(F.array(*[F.col(f"{c}_{i}") for i in range(most)]), lambda x: x.isNotNull()).alias(f"ref_{c}") for c in ("classes", "common")]
    return summed.select("lang", F.coalesce("ref_words", F.lit(0)).alias("ref_words"), *lists)


def kept_rows(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are.  Each goes along with its counts, so no text is shuffled."""
    return _judged(docs, docs.columns[0], text, lang, tuple(docs.columns)).where("kept").select("row.*")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_classes, js_words, js_share).

    A null text has no words and fails; a null language is one of its own, apart from the empty one.  Repeated rows give a row each; an empty
    table gives an empty result; other columns are left out.  The counts are written once to the shared folder,
    since the references need all of them first.
    """
    return _judged(docs, key, text, lang, ()).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_classes", "js_words", "js_share")


def _judged(docs: DataFrame, key: str, text: str, lang: str, carry: tuple[str, ...]) -> DataFrame:
    counted = counts(docs, key, text, lang, carry).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = written(counted, "quality-counts")
    # One row a language: few enough are broadcast, so that the documents stay where they are; for more of them
    # adaptive execution splits a hot language.
    known = written(references(counted).withColumnRenamed("lang", "ref_lang"), "quality-references")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    joined = counted.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")))
    total = lambda c: f"cast(aggregate({c}, 0L, (s, x) -> s + x) as double)"
    for c in ("classes", "common", "ref_classes", "ref_common"):
        joined = joined.withColumn(f"{c}_n", F.expr(total(c)))
    known = F.col("ref_words") >= LEAST_REFERENCE
    js_classes = F.when(known & (F.col("classes_n") >= LEAST_CHARS), _distance("classes", "ref_classes", "classes_n", "ref_classes_n"))
    js_words = F.when(known & (F.col("common_n") >= LEAST_COMMON), _distance("common", "ref_common", "common_n", "ref_common_n"))
    # The two bins are common and other words; unlike the common ones alone they are there for any text with words.
    joined = joined.withColumn("share", F.expr("array(cast(common_n as long), n_words - cast(common_n as long))")).withColumn("ref_share", F.expr("array(cast(ref_common_n as long), ref_words - cast(ref_common_n as long))"))
    joined = joined.withColumn("words_n", F.col("n_words").cast("double")).withColumn("ref_words_n", F.col("ref_words").cast("double"))
    js_share = F.when(known & (F.col("n_words") >= MIN_WORDS), _distance("share", "ref_share", "words_n", "ref_words_n"))
    judged = joined.withColumn("js_classes", js_classes).withColumn("js_words", js_words).withColumn("js_share", js_share)
    far = (F.coalesce("js_classes", F.lit(0.0)) > LIMIT_CLASSES) | (F.coalesce("js_words", F.lit(0.0)) > LIMIT_WORDS) | (F.coalesce("js_share", F.lit(0.0)) > LIMIT_SHARE)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)

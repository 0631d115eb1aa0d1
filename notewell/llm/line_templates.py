"""Line dedup by log templates: a tree of fixed depth over token count and leading tokens, generalised at its leaves.

1. Fields: a token with a digit is a variable field at once, and reads as one sign, if no more than half of the line's
   tokens are such; a row of numbers stays as it is, since its signs alone would be every other row's.
2. Tree: a line goes down by its number of tokens, then by its first LEAD tokens.  Lines that now read the same are one
   leaf; a leaf that recurs in enough documents is a template.
3. Generalisation: the leaves of a node are compared position by position.  Beyond the leading tokens, one that stands
   at its place in fewer than MIN_DOCS documents of the node is a variable field too.  Leaves that agree in what is
   left are one template, if no more than a WILD-th of the tokens became variable that way and half of all tokens are
   still constant.
4. Templates that recur are dropped from all documents but the first, so that what is repeated stays once.

Enough documents are two for lines of LONG tokens, which recur by no chance, and MIN_DOCS for shorter ones and for
generalised templates.  All lines take part.  A caller may leave two kinds alone: lines of fewer than ``min_chars``
characters (brackets, bullets, "Yes."), and with ``keep_copies`` the long lines that two documents share which are copies
of each other, where a join of whole documents comes later and would not find fragments.  Documents are copies if half of
the tokens that the second has in lines of no third document are in lines of these two.

All of it is column expressions.  Hashes of lines and tokens are shuffled; texts only those of documents that lose
lines, in the last join.  What a join will not need is left out before its shuffle by broadcast bits of the keys, whose
number is fixed, so this goes alike at all sizes.  The leaves of a node with no more than NODE tokens are compared in one task,
so that their tokens are shuffled once and as arrays; those of larger nodes are counted token by token over the cluster.
Each count is pre-aggregated.  A template or token that a large part of all lines share is joined by a broadcast whose
size is bounded, as each of its rows stands for at least a fixed part of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import written

LEAD, MIN_DOCS = 2, 3
#: Tokens from which a line is long, and the part of the tokens that may become variable (one in so many).
LONG, WILD = 50, 5
#: Bits for the keys of a join, 64 in a broadcast row; more keys than bits only let more rows through.
BITS = 1 << 26
#: Tokens of all leaves of a node up to which one task compares them.
NODE = 1_000_000
#: A row that is broadcast stands for at least this part of all lines (or tokens), so there are no more rows than that.
HOT_LINES, HOT_TOKENS = 10_000, 100_000
#: What has fewer lines is no hot row, however small the table.
LEAST_HOT = 1_000
#: A token with a digit in it, looked for at the starts of tokens only, and the sign that stands for it.
FIELD, SIGN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", "<*>"
#: White space within a line that isn't one blank.
WIDE = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++"


def plain(text: Column) -> Column:
    """A text, of one or more lines, with one blank between tokens; most need no replacement."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(text, WIDE, " ")).otherwise(text)


def n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def general(line: Column) -> Column:
    """A plain line with its fields as signs, if these are no more than half of its tokens."""
    masked = F.when(2 * F.regexp_count(line, F.lit(FIELD)) <= n_tokens(line), F.regexp_replace(line, FIELD, SIGN)).otherwise(line)
    return F.when(line.rlike("[0-9]"), masked).otherwise(line)


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(id, th, pos, n, path, leaf, t) of each line with at least ``min_chars`` characters, and one at least."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), plain(F.col(text)).alias("text"), F.col(text).rlike("[0-9]").alias("digits"))
    rows = rows.select("id", "th", "digits", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).where(F.length("line") >= max(1, min_chars))
    rows = rows.withColumn("t", F.when(F.col("digits"), general(F.col("line"))).otherwise(F.col("line"))).withColumn("n", n_tokens(F.col("t")).cast("int"))
    return rows.select("id", "th", "pos", "n", F.xxhash64("n", F.substring_index("t", " ", LEAD)).alias("path"), F.xxhash64(F.lit(7), "t").alias("leaf"), "t")


def _documents(in_docs: DataFrame, *by: str) -> DataFrame:
    """Adds up rows of one document each: docs, the smallest id and whether there is a null one."""
    return in_docs.groupBy(*by).agg(F.count("*").alias("docs"), F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("no_id"))


def _first(x: str = "") -> Column:
    """The first document's id: null before all others."""
    return F.when(~F.col(x + "no_id"), F.col(x + "low"))


def _with(rows: DataFrame, table: DataFrame, by: list[str], weight: str, least: int) -> DataFrame:
    """The inner join of ``rows`` with a written table whose rows with weight >= least are few enough to broadcast."""
    hot = table.where(F.col(weight) >= least)
    if not hot.limit(1).count():
        return rows.join(table, by)
    split = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(table.where(F.col(weight) < least), by)
    return split.unionByName(rows.join(F.broadcast(hot), by))


def _marked(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "left_semi") -> DataFrame:
    """The rows that may have a match in ``keys``: all that do and few others; with ``left_anti`` the other rows."""
    bit = F.pmod(F.xxhash64(*by), F.lit(BITS))
    word, mark = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    marks = keys.groupBy(word.alias("_word")).agg(F.bit_or(mark).alias("_marks"))
    return rows.join(F.broadcast(marks), (word == F.col("_word")) & (F.col("_marks").bitwiseAND(mark) != 0), how)


def _leaf_tokens(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, leaf, n, docs, rare, k, toks) of the leaves of nodes in which several may be one template; k: leaves of the node."""
    lines, leaves = lines.where(F.col("n") >= WILD), leaves.where(F.col("n") >= WILD).withColumn("rare", F.col("docs") < _enough())
    nodes = leaves.groupBy("path").agg(F.sum(F.when(F.col("rare"), F.col("docs")).otherwise(0)).alias("d"), F.count(F.when(F.col("rare"), 1)).alias("c"), F.count("*").alias("k"))
    nodes = written(nodes.where((F.col("d") >= MIN_DOCS) & (F.col("c") > 1)).select("path", "k"), "line-nodes")
    members = _marked(leaves, nodes, ["path"]).join(nodes, "path").select("path", "leaf", "n", "docs", "rare", "k")
    members = written(members, "line-members")
    toks = _marked(lines.select("path", "leaf", "t"), members, ["leaf"]).select("path", "leaf", F.transform(F.split("t", " "), lambda w: F.hash(w)).alias("toks"))
    return written(toks.dropDuplicates(["path", "leaf"]).join(members, ["path", "leaf"]).select(*members.columns, "toks"), "line-leaf-tokens")


def _patterns(constants: DataFrame) -> DataFrame:
    """(path, leaf, docs, grp) of the leaves that become templates, from the tokens that stay constant in them."""
    # What the constants leave out of a line's tokens is variable; the constants alone, in any order, name the template.
    constants = constants.withColumn("h", F.xxhash64("i", "tok")).withColumn("f", _is_field().cast("int"))
    pattern = constants.groupBy("path", "leaf").agg(F.max("n").alias("n"), F.max("docs").alias("docs"), F.count("*").alias("c"), F.sum("f").alias("f"), F.bit_xor("h").alias("g"))
    pattern = pattern.where((F.col("c") < F.col("n")) & (WILD * (F.col("n") - F.col("c")) <= F.col("n")) & (2 * (F.col("c") - F.col("f")) >= F.col("n")))
    return pattern.select("path", "leaf", "docs", F.xxhash64(F.lit(9), "n", "g").alias("grp"))


def _is_field() -> Column:
    return F.col("tok") == F.hash(F.lit(SIGN))


def _in_nodes(one: DataFrame) -> DataFrame:
    """The patterns of nodes of which each is whole in a task."""
    tokens = one.repartition("path").select("path", "leaf", "n", "docs", "rare", F.posexplode("toks").alias("i", "tok"))
    tokens = tokens.withColumn("s", F.sum("docs").over(Window.partitionBy("path", "i", "tok")))
    return _patterns(tokens.where(F.col("rare") & ((F.col("i") < LEAD) | _is_field() | (F.col("s") >= MIN_DOCS))))


def _over_cluster(one: DataFrame) -> DataFrame:
    """The patterns of nodes of any size: tokens are counted by themselves and joined with their counts."""
    total = one.agg(F.sum(F.col("n") * F.col("docs"))).first()[0] or 0
    tokens = one.select("path", "leaf", "n", "docs", "rare", F.posexplode("toks").alias("i", "tok"))
    beyond = F.col("i") >= LEAD
    support = tokens.where(beyond).groupBy("path", "i", "tok").agg(F.sum("docs").alias("s")).where(F.col("s") >= MIN_DOCS)
    support = written(support, "line-tokens")
    asked = tokens.where("rare").select("path", "leaf", "n", "docs", "i", "tok")
    held = _with(asked.where(beyond & ~_is_field()), support, ["path", "i", "tok"], "s", max(LEAST_HOT, total // HOT_TOKENS)).select(*asked.columns)
    return _patterns(asked.where(~beyond | _is_field()).unionByName(held))


def _generalised(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, leaf, grp, docs, low, no_id) of the leaves that recur only with further fields generalised."""
    one = _leaf_tokens(lines, leaves)
    size = F.col("k") * F.col("n")
    pattern, large = _in_nodes(one.where(size <= NODE)), one.where(size > NODE)
    if large.limit(1).count():
        pattern = pattern.unionByName(_over_cluster(large))
    pattern = written(pattern, "line-patterns")
    many = pattern.groupBy("path", "grp").agg(F.sum("docs").alias("d")).where(F.col("d") >= MIN_DOCS).select("path", "grp")
    some = written(pattern.join(many, ["path", "grp"]).select("path", "leaf", "grp"), "line-patterns")
    # Documents are counted by their ids: one document may hold many lines of a template.
    in_docs = _marked(lines.select("path", "leaf", "id"), some, ["leaf"]).join(some, ["path", "leaf"]).select("path", "grp", "id").distinct()
    found = _documents(in_docs, "path", "grp").where(F.col("docs") >= MIN_DOCS)
    return some.join(found, ["path", "grp"]).select("path", "leaf", "grp", "docs", "low", "no_id")


def _enough() -> Column:
    return F.when(F.col("n") >= LONG, 2).otherwise(MIN_DOCS)


def _copies(leaves: DataFrame) -> DataFrame:
    """(_one, _two): pairs of documents, the first one null if it has no id, of which the second is a copy of the first."""
    one, two = F.when(~F.col("no_id"), F.col("low")), F.when(F.col("no_id"), F.col("low")).otherwise(F.col("high"))
    shared = leaves.where("docs = 2").groupBy(one.alias("_one"), two.alias("_two")).agg(F.sum("n").alias("shared"))
    ids = F.when((F.col("docs") == 2) & ~F.col("no_id"), F.array("low", "high")).otherwise(F.array("low"))
    own = leaves.where("docs <= 2").select(F.explode(ids).alias("_id"), "n").groupBy("_id").agg(F.sum("n").alias("own"))
    return shared.join(own, F.col("_two") == F.col("_id")).where(F.col("shared") * 2 >= F.col("own")).select("_one", "_two")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1, keep_copies: bool = False) -> DataFrame:
    """(id, th, drop array<int>): for each document that loses lines, their places; th is the hash of its text."""
    lines = written(_lines(docs, key, text, min_chars), "lines")
    in_docs = lines.select("path", "leaf", "id", "n").distinct()
    leaves = in_docs.groupBy("path", "leaf").agg(F.max("n").alias("n"), F.count("*").alias("docs"), F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("no_id"))
    leaves = written(leaves, "line-leaves")
    total = leaves.agg(F.sum("docs")).first()[0] or 0
    enough = leaves.where(F.col("docs") >= _enough())
    if keep_copies:
        same = F.when(~F.col("no_id"), F.col("low")).eqNullSafe(F.col("_one")) & (F.when(F.col("no_id"), F.col("low")).otherwise(F.col("high")) == F.col("_two"))
        enough = enough.where("docs > 2").unionByName(enough.where("docs = 2").join(_copies(leaves), same, "left_anti"))
    exact = enough.select("path", "leaf", F.col("leaf").alias("grp"), "docs", "low", "no_id")
    targets = written(exact.unionByName(_generalised(lines, leaves)), "line-templates")
    # A generalised leaf is rare by itself, but carries its template's documents: it may only be broadcast as what it is.
    weighed = targets.withColumn("weight", F.when(F.col("leaf") == F.col("grp"), F.col("docs")).otherwise(0))
    asked = _marked(lines.select("id", "th", "pos", "path", "leaf"), targets, ["leaf"])
    hit = _with(asked, weighed, ["path", "leaf"], "weight", max(LEAST_HOT, total // HOT_LINES))
    hit = written(hit.select("id", "th", "pos", "path", "grp", _first().alias("first")), "line-hits")
    there = F.col("id").eqNullSafe(F.col("first"))
    own = hit.where(there).select("path", "grp", "id", "th", "pos")
    kept = own.groupBy("path", "grp").agg(F.min(F.struct("th", "pos")).alias("kept"))
    more = own.join(kept, ["path", "grp"]).where(F.struct("th", "pos") != F.col("kept"))
    return hit.where(~there).select("id", "th", "pos").unionByName(more.select("id", "th", "pos")).groupBy("id", "th").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1, keep_copies: bool = False) -> DataFrame:
    """``docs`` with ``text`` without its dropped lines, and ``n_lines`` and ``n_dropped`` put at the end.

    A null text stays null and has no lines.  The first document is the one with the smallest key, and of its rows and
    lines the one with the smallest text hash and place.  Rows that repeat a key and a text lose the same lines; rows
    with a null key count as one document, the first.  Columns of docs named n_lines or n_dropped are replaced.  An
    empty table gives an empty result.
    """
    drops = written(dropped_lines(docs, key, text, min_chars, keep_copies), "line-drops")
    own = docs.select("*", docs[key].alias("_id"), F.xxhash64(docs[text]).alias("_th"))
    # Documents that lose nothing aren't shuffled.
    keys = drops.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    there = F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_th") == F.col("_lost_th"))
    some = _marked(own, keys, ["_id", "_th"]).join(drops.select(F.col("id").alias("_lost_id"), F.col("th").alias("_lost_th"), F.col("drop").alias("_drop")), there, "left").drop("_lost_id", "_lost_th")
    joined = some.unionByName(_marked(own, keys, ["_id", "_th"], "left_anti").withColumn("_drop", F.lit(None).cast("array<int>")))
    lines = F.split(text, "\n", -1)
    rest = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drop", i)), "\n"))
    columns = [rest.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row; the digest is that of what is left (null: empty)."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
p as (
  select *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) as plain from l),
w as (select *, string_split(plain, ' ') as ws from p where plain <> ''),
t as (
  select doc_id, pos, len(ws) as n, case when 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) <= len(ws)
    then list_transform(ws, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) else ws end as ws from w),
u as (select *, ws[1:2] as lead from t),
d as (select ws, n, lead, count(distinct doc_id) as docs, min(doc_id) as lo, max(doc_id) as hi from u group by ws, n, lead),
k as (select *, unnest(ws) as x, unnest(range(n)) as i from d where n >= 5),
s as (select n, lead, i, x from k where i >= len(lead) group by n, lead, i, x having sum(docs) >= 3),
c as (
  select k.ws, k.n, list(struct_pack(i := k.i, x := k.x) order by k.i) as g, count(*) as c, count(*) filter (where k.x = '<*>') as f
  from k left join s on k.n = s.n and k.lead = s.lead and k.i = s.i and k.x = s.x
  where k.docs < case when k.n >= 50 then 2 else 3 end and (k.i < len(k.lead) or k.x = '<*>' or s.x is not null) group by k.ws, k.n),
g as (select ws, n, g from c where c < n and 5 * (n - c) <= n and 2 * (c - f) >= n),
h as (select n, g from g join u using (ws, n) group by n, g having count(distinct doc_id) >= 3),
r as (
  select ws, n, null as g from d where docs >= 3 or n >= 50 and docs = 2
  union all select g.ws, g.n, g.g from g join h on g.n = h.n and g.g = h.g),
m as (
  select u.doc_id, u.pos, row_number() over (partition by r.n, case when r.g is null then r.ws end, r.g order by u.doc_id, u.pos) > 1 as dropped
  from u join r on u.ws = r.ws)
select d.doc_id, coalesce(max(s.n), 0)::bigint as n_lines, coalesce(max(s.k), 0)::bigint as n_dropped, sha256(coalesce(max(s.kept), '')) as kept_sha256
from documents d left join (
  select l.doc_id, count(*) as n, count(*) filter (where m.dropped) as k, string_agg(line, chr(10) order by l.pos) filter (where m.dropped is not true) as kept
  from l left join m on l.doc_id = m.doc_id and l.pos = m.pos group by l.doc_id) s on d.doc_id = s.doc_id
group by d.doc_id
"""

"""A vault of markdown notes rendered from the star schema, so that answers can be stated from the tables alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"F": "done", "O": "open", "P": "abandoned"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is read in fewer tasks than there are cores, dealt to all of them.

    A small table is one file and one task, and notes are rendered and parsed where their rows are; only the table's own
    narrow rows are shuffled.  A table of many files is left as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


#: Rows a task at most, where a note is rendered and parsed for each.
ROWS = 20_000


def _spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Narrow rows, one for each of ``table``, dealt to as many tasks as they need; counting reads no column.

    However they were read or joined, no task has more than about ``ROWS`` of them, and no core is idle.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS)), F.xxhash64(key))


def _text(expression: str):
    return F.expr(expression)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket an order; fields are missing, empty or of another kind by the key's remainders."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = _spread(orders.join(customers, orders.o_custkey == customers.c_custkey), orders, "o_orderkey")
    k = "o_orderkey"
    front = f"""concat('---\\ntype: ticket\\n',
      'slug: "', if({k} % 29 = 0, concat('x', {k}), cast({k} as string)), '"\\n',
      'description: Order ', {k}, ' of customer ', o_custkey, '\\n',
      case when {k} % 13 = 0 then 'status:\\n' else concat('status: ', case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'abandoned' end, '\\n') end,
      'project: "[[', c_mktsegment, ']]"\\n',
      'kind: ', lower(regexp_replace(substr(o_orderpriority, 3), ' ', '-')), '\\n',
      'track: "[[41 projects/tracks/track-', c_nationkey, if({k} % 59 = 0, '-old', ''), '|track ', c_nationkey, ']]"\\n',
      'tags: [', lower(regexp_replace(substr(o_orderpriority, 3), ' ', '-')), ', "', lower(c_mktsegment), '"', if({k} % 5 = 0, concat(', once-', {k}), ''), ']\\n',
      case when {k} % 11 = 0 then '' else concat('cost: ', cast(cast(o_totalprice as decimal(18,2)) as string), '\\n') end,
      'items: ', {k} % 4, '\\n',
      'done: ', if(o_orderstatus = 'F', 'true', 'false'), '\\n',
      case when {k} % 17 = 0 then 'superseded: true\\n' else '' end,
      case when {k} % 101 = 0 then 'template: true\\n' else '' end,
      case when {k} % 19 = 0 then 'epistemic_status: provisional\\n' else '' end,
      case when {k} % 23 = 0 then 'colour: red\\n' else '' end,
      case when {k} % 101 = 0 then 'stage: [draft, final]\\n' when {k} % 37 = 0 then 'stage: rough\\n' else '' end,
      case when {k} % 101 <> 0 and {k} % 43 = 0 then 'smell: none\\n' else '' end,
      'created: ', date_format(o_orderdate, 'yyyy-MM-dd'), '\\n',
      case when {k} % 31 = 0 then '' else concat('updated: ', date_format(o_orderdate, 'yyyy-MM-dd'), '\\n') end,
      case when {k} % 7 = 0 then concat('requires:\\n  - "[[ticket-', {k} + 1, ']]"\\n', if({k} % 14 = 0, concat('  - "[[ticket-gone-', {k}, ']]"\\n'), '')) else '' end,
      '---\\n')"""
    body = f"""concat('# Order ', {k}, '\\n\\nSee [[track-', c_nationkey, ']] and [[card-', o_custkey, '#Notes|card]].\\n`[[not-a-link]]` stays.\\n\\n',
      '```\\n[[nor-this]]\\n```\\n\\n## Notes\\n\\nFirst line.\\n\\n### Detail\\n\\n', if({k} % 3 = 0, concat('Again [[Card-', o_custkey, '.md]].\\n'), 'Nothing more.\\n'), '\\n## Tasks\\n\\n- [ ] ship\\n')"""
    return rows.select(_text(f"concat('41 projects/', c_mktsegment, '/ticket-', {k}, '.md')").alias("rel"), F.concat(_text(front), _text(body)).alias("content"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(
        _text("concat('41 projects/tracks/track-', n_nationkey, '.md')").alias("rel"),
        _text("concat('---\\ntype: track\\nslug: \"', n_nationkey, '\"\\ndescription: ', n_name, '\\nstatus: ', if(n_nationkey % 2 = 0, 'active', 'paused'), '\\nproject: \"[[', n_regionkey, ']]\"\\ncreated: 2024-01-01\\nupdated: 2024-01-01\\n---\\nTrack of [[region-', n_regionkey, ']].\\n')").alias("content"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt to be rendered as notes."""
    rows = _table(spark, sf_dir, "part")
    return _spread(rows, rows, "p_partkey")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card a part; it refers to a supplier, and its body to another card that may not exist."""
    k = "p_partkey"
    return parts(spark, sf_dir).select(
        _text(f"concat('20 cards/card-', {k}, '.md')").alias("rel"),
        _text(f"""concat('---\\ntype: card\\ndescription: ', p_name, '\\n', if({k} % 9 = 0, '', concat('tags: [', lower(p_type), ', ', lower(regexp_replace(p_brand, '#', '-')), ']\\n')),
          'reference: ', if({k} % 6 = 0, '"plain text"', concat('"[[30 references/ref-', {k} % 150, ']]"')), '\\n', if({k} % 21 = 0, 'superseded: true\\n', ''), 'size: ', p_size, '\\n---\\n',
          'A ', p_name, ' links to [[card-', {k} * 3, ']] and [[ref-', {k} % 120, '|its source]].\\n\\n## Glossary\\n\\n| Term | Meaning |\\n| --- | --- |\\n| Alpha ', {k}, ' | first |\\n| Beta | second |\\n\\n## Relations\\n\\n- Beta subsumes:: Alpha ', {k}, '\\n- ', if({k} % 4 = 0, 'Gamma', 'Beta'), ' ', if({k} % 10 = 0, 'likes', 'part-of'), ':: [[card-', if({k} % 25 = 24, {k}, {k} + 1), ']] (always)\\n')""").alias("content"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "s_suppkey"
    return _table(spark, sf_dir, "supplier").select(
        _text(f"concat('30 references/ref-', {k}, '.md')").alias("rel"),
        _text(f"concat('---\\ntype: ', if({k} % 8 = 0, 'note', 'reference'), '\\ndescription: ', s_name, '\\ntags: [supplier]\\n---\\nSupplier [[nation-', s_nationkey, ']].', if({k} % 5 = 0, concat(' Sells [[card-', {k}, ']].'), ''), '\\n')").alias("content"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note a document; labels give trust."""
    docs = _dealt(_table(spark, sf_dir, "documents"), "doc_id").join(_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")), "doc_id", "left")
    return docs.select(
        _text("concat('10 notes/', lang, '/note-', doc_id, '.md')").alias("rel"),
        _text("concat('---\\ntype: note\\ndescription: Note ', doc_id, ' in ', lang, '\\ntags: [', lang, ', ', source, ']\\n', if(toxic = 1, 'superseded: true\\n', ''), if(quality = 0, 'epistemic_status: provisional\\n', ''), '---\\n', text)").alias("content"),
    )


def weekly_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log an ISO week of events: purchases and signups are tasks, errors are backlog; clicks of a day make its sleep."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("week", F.concat(F.date_format(F.date_add(F.date_trunc("week", "ts").cast("date"), 3), "yyyy"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")))
    line = F.concat(F.lit("- [x] ("), F.col("day"), F.lit(") [[user-"), F.col("user_id").cast("string"), F.lit("]]"))
    lines = lambda kinds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type").isin(kinds), F.struct("event_id", line.alias("line"))))), lambda x: x["line"]), "\n")
    days = events.groupBy("week", "day").agg(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"))
    sleep = days.where("clicks % 5 <> 0").groupBy("week").agg(F.array_join(F.array_sort(F.collect_list("day")), ", ").alias("sleep"))
    first = F.min_by(F.when(F.col("event_type").isin("purchase", "signup"), F.col("user_id")), F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_id")))
    weeks = events.groupBy("week").agg(lines(["purchase", "signup"]).alias("tasks"), lines(["error"]).alias("backlog"), first.alias("user")).join(sleep, "week", "left")
    # Even weeks name a project that is done, odd ones also one that isn't.
    project = F.when(F.col("user").isNull(), "").otherwise(F.concat(F.lit("- [[user-"), F.col("user").cast("string"), F.lit("]]\n"), F.when(F.substring("week", 7, 2).cast("int") % 2 == 1, "- [[user-none]]\n").otherwise("")))
    return weeks.select(
        F.concat(F.lit("50 logs/"), "week", F.lit(".md")).alias("rel"),
        F.concat(F.lit("---\ntype: weekly-log\nweek: "), "week", F.lit("\nsleep: ["), F.coalesce("sleep", F.lit("")), F.lit("]\n---\n\n## Tasks\n\n"), "tasks", F.lit("\n\n## Backlog\n\n"), "backlog", F.lit("\n\n## Projects\n\n"), project).alias("content"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft a customer, each with one of eight faults, by the key's remainder."""
    k = "c_custkey"
    return _table(spark, sf_dir, "customer").select(
        _text(f"concat('60 drafts/draft', case when {k} % 16 = 3 then '  ' when {k} % 16 = 11 then '’' else '-' end, {k}, '.md')").alias("rel"),
        _text(f"""concat('---\\n', case {k} % 8 when 0 then '' when 5 then 'type: scratchpad\\n' else 'type: note\\n' end, 'description: draft\\ntags: ', if({k} % 8 = 4, '[open', '[draft]'), '\\n', if({k} % 8 = 7, concat('related: [[card-', {k}, ']]\\n'), ''), '---\\n',
          case {k} % 8 when 1 then '- item\\n\\n  > [!Note] Title\\n  > runs on\\n\\n> [!Tip] Apart\\n>\\n> text\\n' when 2 then concat('# draft-', {k}, '\\n\\nText.\\n') when 6 then 'See src/*.ts and dist/*.js, __init__ or ___x___, **fine**, not *this*.\\n' else 'Text.\\n\\n# Later\\n' end)""").alias("content"),
    )


KINDS = {"ticket": tickets, "track": tracks, "card": cards, "reference": references, "note": documents, "weekly-log": weekly_logs, "draft": drafts}


def vault(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(rel, content) of the named kinds of notes, or of all."""
    return reduce(DataFrame.unionByName, [KINDS[k](spark, sf_dir) for k in kinds or KINDS])

"""Experience points from weekly logs: daily sums, coverage bonus, sleep streak, months, levels."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions import text

#: Points a level.
LEVEL = 50
TASK = r"^- \[x\] \((\d{4}-\d{2}-\d{2})\)"


def _section(logs: DataFrame, heading: str) -> DataFrame:
    """(rel, week, line): the lines below ``## heading`` up to the next heading of that level."""
    lines = text.lines(F.col("content"))
    rows = logs.select("rel", text.shown(F.col("fm")["week"]["display"]).alias("week"), lines.alias("lines"))
    begin = F.array_position(F.transform("lines", lambda x: x.startswith("## ") & (F.trim(F.regexp_extract(x, r"^## (.*)$", 1)) == heading)), True)
    rows = rows.withColumn("begin", begin).where("begin > 0").withColumn("rest", F.expr("slice(lines, cast(begin as int) + 1, size(lines))"))
    stop = F.array_position(F.transform("rest", lambda x: x.startswith("## ")), True)
    return rows.withColumn("stop", stop).select("rel", "week", F.explode(F.when(F.col("stop") > 0, F.expr("slice(rest, 1, cast(stop as int) - 1)")).otherwise(F.col("rest"))).alias("line"))


def daily(logs: DataFrame) -> DataFrame:
    """(day, tasks, bonus): +1 a done task, -1 a done backlog item, and the bonus of covered projects."""
    counted = lambda heading, sign: _section(logs, heading).select(F.regexp_extract("line", TASK, 1).alias("day"), F.lit(sign).alias("x")).where("day <> ''")
    tasks = counted("Tasks", 1).union(counted("Backlog", -1)).groupBy("day").agg(F.sum("x").alias("tasks"))
    return tasks.join(bonus(logs), "day", "full").select("day", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("bonus", F.lit(0)).alias("bonus"))


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("rel", "week", F.explode(F.regexp_extract_all("line", F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("link"))


def bonus(logs: DataFrame) -> DataFrame:
    """(day, bonus): a week all of whose projects are linked from done tasks gives their number to next Monday."""
    projects = _links(_section(logs, "Projects"))
    done = _links(_section(logs, "Tasks").where(F.col("line").rlike(TASK))).select("rel", "link").distinct().withColumn("done", F.lit(1))
    weeks = projects.join(done, ["rel", "link"], "left").groupBy("rel", "week").agg(F.count("*").alias("n"), F.count("done").alias("covered")).where("n = covered and week <> ''")
    monday = F.date_add(text.iso_week_monday(F.col("week")), 7)
    return weeks.select(F.date_format(monday, "yyyy-MM-dd").alias("day"), "n").where("day is not null").groupBy("day").agg(F.sum("n").alias("bonus"))


def sleep_days(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode(F.col("fm")["sleep"]["items"]).alias("day")).where("day <> ''").distinct()


def streak(days: DataFrame, today: datetime.date) -> DataFrame:
    """(day, rank): the unbroken run of days up to yesterday, with today if it is there; ranks count from the oldest, 7 at most.

    Days less their row number are the same within a run; the run that counts is the one that holds yesterday.
    """
    d = days.select(F.to_date("day").alias("d")).where(F.col("d") <= F.lit(today)).distinct()
    past = d.where(F.col("d") < F.lit(today)).withColumn("island", F.date_sub("d", F.row_number().over(Window.orderBy("d"))))
    last = past.where(F.col("d") == F.date_sub(F.lit(today), 1)).select(F.col("island").alias("_island"))
    run = past.join(F.broadcast(last), F.col("island") == F.col("_island")).select("d").union(d.where(F.col("d") == F.lit(today)))
    return run.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.least(F.row_number().over(Window.orderBy("d")), F.lit(7)).alias("rank"))


def points(logs: DataFrame, today: datetime.date) -> DataFrame:
    """(day, xp): tasks, bonus and streak rank of each day."""
    parts = daily(logs).join(streak(sleep_days(logs), today), "day", "full")
    return parts.select("day", (F.coalesce("tasks", F.lit(0)) + F.coalesce("bonus", F.lit(0)) + F.coalesce("rank", F.lit(0))).alias("xp"))


def totals(days: DataFrame) -> DataFrame:
    """(month, xp, level): sums by month, and of the year under a null month; division drops the rest."""
    return days.rollup(F.substring("day", 1, 7).alias("month")).agg(F.sum("xp").alias("xp")).withColumn("level", F.expr(f"xp div {LEVEL}"))

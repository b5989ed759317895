"""Recent churn of files: from version-control numstat text, or from tables of commits and of what they changed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordered import carried_forward
from corvane.session import work_folder


def numstat(texts: DataFrame, column: str = "text", compat: bool = True) -> DataFrame:
    """``(path, churn_loc)``: added and deleted lines summed by path; binary files are left out.

    A renamed path ``dir/{old => new}`` keeps only what follows the arrow in a compatible run, and its directory otherwise.
    """
    rows = texts.select(F.explode(F.split(column, r"\r?\n")).alias("line"))
    part = F.split("line", "\t", 3)
    rows = rows.select(F.try_to_number(F.get(part, 0), F.lit("999999999")).cast("long").alias("added"), F.try_to_number(F.get(part, 1), F.lit("999999999")).cast("long").alias("deleted"), F.get(part, 2).alias("raw")).filter("added IS NOT NULL AND deleted IS NOT NULL AND raw <> ''")
    raw = F.col("raw")
    new = F.regexp_extract(raw, r"=> ([^}]*)", 1)
    whole = F.regexp_replace(F.regexp_replace(raw, r"\{[^{}]* => ([^{}]*)\}", "$1"), "//", "/")
    path = F.when(raw.contains(" => "), F.trim(new) if compat else F.when(raw.contains("{"), whole).otherwise(F.trim(new))).otherwise(raw)
    return rows.groupBy(path.alias("path")).agg(F.sum(F.col("added") + F.col("deleted")).alias("churn_loc"))


def newest(rows: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    """The so many rows that are last by ``ts``, of equal ones those with the largest ``tie``, which must be unique among them.

    The time from which on all rows belong to them is found by counts: by hour, then by second within the hour in which the limit falls.  Only rows of one
    second are sorted, so any limit is taken without one task that sorts all.
    """
    kept, open_, left = [], rows.filter(F.col(ts).isNotNull()), limit
    for unit in ("hour", "second"):
        at = F.date_trunc(unit, ts)
        counts = open_.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as the window has hours, and an hour seconds
        so_far = counts.withColumn("_sum", F.sum("_n").over(Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)))
        cut = so_far.filter(F.col("_sum") >= left).orderBy(F.desc("_at")).first()
        if cut is None:  # the limit is beyond all rows, which only the first counts can tell
            return rows.filter(F.col(ts).isNotNull())
        kept.append(open_.filter(at > cut["_at"]))
        open_, left = open_.filter(at == cut["_at"]), left - (cut["_sum"] - cut["_n"])
    out = open_.orderBy(F.desc(ts), F.desc(tie)).limit(left)
    for part in kept:
        out = out.unionByName(part)
    return out


def recent(commits: DataFrame, ts: str, as_of: datetime, days: int = 14, limit: int = 1000, tie: str = "commit") -> DataFrame:
    """Commits of the last days, the newest so many at most, which is the window of the churn feature."""
    return newest(commits.filter(F.col(ts) >= F.lit(as_of - timedelta(days=days))), ts, tie, limit)


def collect(commits: DataFrame, diffs: DataFrame, as_of: datetime, days: int = 14, limit: int = 1000, under: str = "", follow: bool = False) -> DataFrame:
    """``(path, churn_loc)``: lines added and deleted by the newest commits of the last days that are no merges and touch a path below ``under``.

    ``commits(commit, seq, ts, merge)``, where ``seq`` numbers commits from old to new, and ``diffs(commit, path, old_path, added, deleted)``, where ``old_path`` is set if
    the commit renamed the file, and counts are null for binary files.  A null ``merge`` is none.  With ``follow`` a file's lines count for the name that it has now.
    """
    below = diffs.filter(F.col("path").startswith(under)) if under else diffs.filter("path IS NOT NULL")
    plain = commits.filter(~F.coalesce("merge", F.lit(False))).join(below.select("commit"), "commit", "left_semi")
    chosen = recent(plain, "ts", as_of, days, limit).select("commit", "seq")
    lines = below.filter("added IS NOT NULL AND deleted IS NOT NULL").join(chosen, "commit").select("path", "seq", (F.col("added") + F.col("deleted")).alias("_loc"))
    if follow:
        renames = diffs.filter("old_path IS NOT NULL").join(commits.select("commit", "seq"), "commit").select("seq", "old_path", "path")
        lines = moved(lines.groupBy("path", "seq").agg(F.sum("_loc").alias("_loc")), renames).drop("path").withColumnRenamed("now", "path")
    return lines.groupBy("path").agg(F.sum("_loc").alias("churn_loc"))


def moved(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Adds ``now``: the name that a file which was ``path`` at ``seq`` has after all later renames ``(seq, old_path, path)``.

    A name may be given up and used again.  Each rename leads to the next one of the name it gives, an as-of join along ``seq``; chains are followed by doubling, in as
    many rounds as the logarithm of the longest, and a rename whose chain has ended takes no further part.  Of several renames of one name at one ``seq`` the least new name counts.
    Rows and renames are written once, as they are read more than once.
    """
    spark = rows.sparkSession
    folder = work_folder(spark)

    def kept(name: str, table: DataFrame) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    events = kept("renames", renames.groupBy(F.col("old_path").alias("path"), "seq").agg(F.min("path").alias("name")))
    gives_up = events.select("path", (-2 * F.col("seq")).alias("_at"), F.col("seq").cast("long").alias("_next"))

    def next_of(asks: DataFrame) -> DataFrame:
        """For ``(path, _seq, _row)``, where ``_row`` isn't null, the first rename of ``path`` after ``_seq``."""
        asks = asks.select("path", (-2 * F.col("_seq") - 1).alias("_at"), F.lit(None).cast("long").alias("_next"), "_row")
        found = carried_forward(asks.unionByName(gives_up, allowMissingColumns=True), ["path"], "_at", F.col("_next"), "_then")
        return found.filter("_row IS NOT NULL").select("path", "_then", "_row")

    steps = next_of(events.select(F.col("name").alias("path"), F.col("seq").alias("_seq"), F.struct("path", "seq").alias("_row")))
    steps = kept("steps_0", steps.select("_row.path", "_row.seq", F.col("path").alias("name"), F.col("_then").alias("then")))
    ended, open_, done = steps.filter("then IS NULL"), steps.filter("then IS NOT NULL"), 0
    while not open_.isEmpty():
        on = ended.unionByName(open_).select(F.col("path").alias("name"), F.col("seq").alias("then"), F.col("name").alias("_name"), F.col("then").alias("_then"))
        done += 1
        now = open_.join(on, ["name", "then"], "left").select("path", "seq", F.coalesce("_name", "name").alias("name"), F.col("_then").alias("then"))
        now = kept(f"steps_{done}", now)
        ended, open_ = ended.unionByName(now.filter("then IS NULL")), now.filter("then IS NOT NULL")
    whole = kept("rows", rows.select("path", F.col("seq").cast("long").alias("_seq"), F.struct("*").alias("_row")))
    asked = next_of(whole).select("path", "_then", "_row")
    names = ended.select("path", F.col("seq").alias("_then"), F.col("name").alias("now"))
    return asked.join(names, ["path", "_then"], "left").select("_row.*", F.coalesce("now", "path").alias("now"))

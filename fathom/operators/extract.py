"""Extraction from texts: lines with a carried state, step buckets, bullets of a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as X


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): cleaned lines from position 1; texts without lines give no row."""
    return df.select(key, F.posexplode(X.lines(F.col(text))).alias("_p", "line")).select(key, (F.col("_p") + 1).cast("bigint").alias("pos"), "line")


def carried(lines: DataFrame, key: str, state: Column, out: str = "state") -> DataFrame:
    """``lines`` with the last state that is not null up to each line of the same key."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(out, F.last(state, ignorenulls=True).over(w))


def step_number(line: Column) -> Column:
    """The number of a ``STEP n`` line, full-width digits too; null for other lines."""
    number = F.regexp_extract(X.ascii_digits(line), r"^(?i)STEP\s*([0-9]+)", 1)
    return F.nullif(number, F.lit("")).try_cast("bigint")


def step_lines(df: DataFrame, key: str, text: str, *, notes: list[str], steps: int = 5) -> DataFrame:
    """(key, pos, bucket, line): lines under ``STEP n`` (bucket n), under a notes marker (bucket 0) or before any (null).

    Marker lines themselves are dropped, as are lines of dashes; a step beyond ``steps`` carries
    its lines to the null bucket.
    """
    return step_buckets(numbered_lines(df, key, text), key, notes=notes, steps=steps)


def step_buckets(lines: DataFrame, key: str, *, notes: list[str], steps: int = 5) -> DataFrame:
    """``step_lines`` of lines (key, pos, line); pos may be any ordered value."""
    step, note = step_number(F.col("line")), X.contains_any(F.col("line"), notes)
    marked = lines.withColumn("_m", F.when(note, F.lit(0).cast("bigint")).when(step.isNotNull(), F.when(step.between(1, steps), step).otherwise(-1))).transform(lambda d: carried(d, key, F.col("_m"), "_s"))
    clean = X.utrim(F.ltrim(F.col("line"), F.lit("-")))
    return marked.where(F.col("_m").isNull()).select(key, "pos", F.when(F.col("_s") >= 0, F.col("_s")).alias("bucket"), clean.alias("line")).where("line <> ''")


def step_answer(rows: DataFrame, key: str, *, brief: bool, steps: int = 5) -> DataFrame:
    """(key, bucket, lines): per bucket the first distinct lines, 1 a step (2 for step 4) and 2 notes if brief, else 2 and 6."""
    lines = rows.where("bucket is not null").groupBy(key, "bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    most = F.when(F.col("bucket") == 0, 2 if brief else 6).when(F.lit(not brief) | (F.col("bucket") == 4), 2).otherwise(1)
    return lines.select(key, "bucket", F.slice(X.unique(F.transform("l", lambda x: x["line"])), F.lit(1), most).alias("lines"))


def section_or(main: Column, other: Column, titles: list[str], stops: list[str]) -> Column:
    """The section of the main text, or where it has none the one of the other text, up to its end."""
    return F.coalesce(X.empty_as_null(X.section(main, titles, stops)), X.section(other, titles, []))


def bullets(section: Column, *, keep: list[str], short: int | Column | None = None, drop: list[str] = (), most: int = 12) -> Column:
    """Distinct lines of a section, without question-and-answer lines and leading dashes: headings ``n)``,
    lines with a word of ``keep``, or any of up to ``short`` characters; none with a word of ``drop``."""
    plain = F.filter(X.lines(section), lambda x: ~(x.startswith("【Q】") | x.startswith("【A】")))
    clean = F.filter(F.transform(plain, lambda x: X.utrim(F.ltrim(x, F.lit("-")))), lambda x: x != "")
    wanted = lambda x: x.rlike(r"^\d+[）)]") | X.contains_any(x, keep) | (F.length(x) <= (F.lit(0) if short is None else short))
    return F.slice(F.filter(X.unique(F.filter(clean, wanted)), lambda x: ~X.contains_any(x, list(drop))), 1, most)

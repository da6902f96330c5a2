"""Shown forms of a diff besides the patch: a line per file with statuses, names or counts, and the summary.

Input is a diff's ``path, old_path, status, old_mode, new_mode``; ``stat`` adds ``additions, deletions, binary`` and the two sizes.
Every form is an expression per row; only the widest name and the largest count are asked of the whole diff, one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits: columns of a stat line, and the least that the bar gets of them.
WIDTH, LEAST_BAR = 80, 7


def _old() -> Column:
    return F.coalesce("old_path", "path")


def name_only(diff: DataFrame) -> DataFrame:
    """``path, line`` in path order: the name on the new side."""
    return diff.select("path", F.col("path").alias("line")).orderBy("path")


def name_status(diff: DataFrame) -> DataFrame:
    """``path, line`` in path order: the status letter and the name, both names where they or the modes differ.

    An executable file has a star behind its name; a name followed by another one has a space instead.
    """
    star = lambda m, other: F.when(F.col(m).bitwiseAND(0o100) != 0, "*").otherwise(other)
    both = F.concat("status", F.lit("\t"), _old(), star("old_mode", " "), F.lit(" "), F.col("path"), star("new_mode", " "))
    one = F.concat("status", F.lit("\t"), _old(), star("old_mode", ""))
    two = (F.col("old_path") != F.col("path")) | (F.col("old_mode") != F.col("new_mode"))
    return diff.select("path", F.when(F.coalesce(two, F.lit(False)), both).otherwise(one).alias("line")).orderBy("path")


def _renamed() -> Column:
    """``dir/{old => new}``, or ``old => new`` without a common directory."""
    a, b = F.split("old_path", "/"), F.split("path", "/")
    same = F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(same, False) - 1, F.lit(-1)), F.size(same))
    rest = lambda x: F.array_join(F.slice(x, n + 1, F.size(x)), "/")
    short = F.concat(F.array_join(F.slice(a, F.lit(1), n), "/"), F.lit("/{"), rest(a), F.lit(" => "), rest(b), F.lit("}"))
    return F.when(n > 0, short).otherwise(F.concat("old_path", F.lit(" => "), F.col("path")))


def stat(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """``path, line`` in path order: name, number of changed lines, and a bar of their shares, within ``width`` columns.

    Bars are cut to scale only if the largest count does not fit; a binary file tells its sizes (``old_size, new_size``).
    """
    n = F.col("additions") + F.col("deletions")
    named = files.withColumn("name", F.when(F.col("status") == "R", _renamed()).otherwise(F.col("path"))).withColumn("n", n)
    facts = named.agg(F.max(F.length("name")).alias("most_name"), F.max("n").alias("most_n")).withColumn("digits", F.length(F.col("most_n").cast("string")))  # one row
    room = F.greatest(F.lit(width) - F.col("most_name") - F.col("digits") - 5, F.lit(LEAST_BAR))
    j = named.join(F.broadcast(facts.withColumn("room", room)), F.lit(True))
    full = F.when(F.col("most_n") <= F.col("room"), F.col("n")).otherwise(F.floor((F.col("n") * F.col("room") + F.floor(F.col("most_n") / 2)) / F.col("most_n"))).cast("int")
    plus = F.when(F.col("n") > 0, F.floor(full * F.col("additions") / F.col("n"))).otherwise(0).cast("int")
    bar = F.when(F.col("n") > 0, F.concat(F.lit(" "), F.repeat(F.lit("+"), plus), F.repeat(F.lit("-"), full - plus))).otherwise("")
    counts = F.concat(F.lpad(F.col("n").cast("string"), F.col("digits"), " "), bar)
    sizes = F.concat(F.lit("Bin "), F.coalesce("old_size", F.lit(0)).cast("string"), F.lit(" -> "), F.coalesce("new_size", F.lit(0)).cast("string"), F.lit(" bytes"))
    return j.select("path", F.concat(F.lit(" "), F.rpad("name", F.col("most_name"), " "), F.lit(" | "), F.when(F.col("binary"), sizes).otherwise(counts)).alias("line")).orderBy("path")


def summary(files: DataFrame) -> DataFrame:
    """``line``: how many files, insertions and deletions; a kind of line that no file has is left out if the other is there."""
    t = files.agg(F.count("*").alias("f"), F.coalesce(F.sum("additions"), F.lit(0)).alias("a"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("d"))
    s = lambda c: F.when(F.col(c) == 1, "").otherwise("s")
    come = F.when((F.col("a") > 0) | (F.col("d") == 0), F.concat(F.lit(", "), F.col("a").cast("string"), F.lit(" insertion"), s("a"), F.lit("(+)"))).otherwise("")
    gone = F.when((F.col("d") > 0) | (F.col("a") == 0), F.concat(F.lit(", "), F.col("d").cast("string"), F.lit(" deletion"), s("d"), F.lit("(-)"))).otherwise("")
    return t.select(F.concat(F.lit(" "), F.col("f").cast("string"), F.lit(" file"), s("f"), F.lit(" changed"), come, gone).alias("line"))

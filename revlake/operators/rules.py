"""Rules that files in the tree give for paths below them: ignore lists and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions import globs as G
from revlake.functions import paths as P


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """``(glob, negated)`` of an ignore file's lines; blank lines and comments are left out."""
    out = []
    for line in text.split("\n"):
        line = line.strip(" \t\r")
        if line and not line.startswith("#"):
            out.append((line[1:], True) if line.startswith("!") else (line, False))
    return out


def ignored(path: Column | str, rules: list[tuple[str, str, bool]]) -> Column:
    """The last rule ``(base, glob, negated)`` that matches decides; root first, deeper bases later.

    A rule sees the path relative to its base.  The rules of a workspace are few: they become one expression, tried
    from the last to the first.
    """
    p = P.col(path)
    out = None
    for base, glob, negated in reversed(rules):
        rest = F.substring(p, F.lit(len(base) + 2 if base else 1), F.length(p))
        hit = P.is_within(p, F.lit(base)) & G.matches(rest, glob)
        out = F.when(hit, F.lit(not negated)) if out is None else out.when(hit, F.lit(not negated))
    return out.otherwise(False) if out is not None else F.lit(False)


def attribute(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, state``: the attribute state of each path, null where no rule says anything.

    ``rules`` is ``base, line, glob, regex, state``; a path is joined with the rules of its ancestor directories (an equi-join on the
    exploded ancestors), and the deepest directory's last matching line wins.  ``regex`` comes from ``rule_rows``.
    """
    dirs = F.concat(F.array(F.lit("")), P.ancestors_of("path"))
    asked = paths.select("path", F.explode(dirs).alias("base"))
    j = asked.join(rules, "base")
    rest = F.when(F.col("base") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("base") + 2, F.length("path")))
    hit = j.withColumn("rest", rest).where("rest rlike regex")
    best = hit.groupBy("path").agg(F.max_by("state", F.struct(F.length("base"), "line")).alias("state"))
    return paths.select("path").join(best, "path", "left")


def rule_rows(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``base, line, glob, regex, state`` from ``(base, glob, state)`` in file order."""
    rows = [(b, i, g, G.glob_regex(g), s) for i, (b, g, s) in enumerate(rules)]
    return spark.createDataFrame(rows, "base string, line int, glob string, regex string, state string")


def rule_sources(paths: DataFrame, entries: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``base, path``: the rule files that exist in ancestor directories of the paths, root first."""
    dirs = paths.select(F.explode(F.concat(F.array(F.lit("")), P.ancestors_of("path"))).alias("base")).distinct()
    wanted = dirs.select("base", P.join("base", F.lit(name)).alias("path"))
    return wanted.join(entries.select("path"), "path", "left_semi").select("base", "path").orderBy(P.depth("base"), "base")

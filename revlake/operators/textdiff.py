"""Line differences: edit scripts, hunks, patches, statistics and blame.

Files are paired, and versions ordered, by Spark joins; one pair of texts is compared in a small Python helper inside Arrow
batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions import content as K
from revlake.functions import paths as P
from revlake.operators.staging import with_sum_before

#: Fixed limits: bytes of a rendered diff by default and at most, lines of context.
PATCH_BYTES, MOST_PATCH_BYTES, CONTEXT = 4 << 20, 64 << 20, 3


def split_lines(text: str) -> tuple[list[str], bool]:
    """Lines, and whether the last one is ended."""
    if not text:
        return [], True
    parts = text.split("\n")
    return (parts[:-1], True) if parts[-1] == "" else (parts, False)


def _ended_lines(text: str) -> list[str]:
    """Lines with their line feeds, so that an unended last line differs from the ended one."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + parts[-1:] * bool(parts[-1])


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """A shortest edit script by the greedy O(ND) search: ``(' ', i, j)``, ``('-', i, j)``, ``('+', i, j)``.

    Equal lines at both ends are taken off first; they are in some shortest script.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[len(old) - 1 - tail] == new[len(new) - 1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    # lines that only one side has are in no common subsequence
    both = set(a) & set(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    out = [(" ", k, k) for k in range(head)]
    i = j = 0
    for x, y in [*((at_a[p], at_b[q]) for p, q in _matches([a[k] for k in at_a], [b[k] for k in at_b])), (len(a), len(b))]:
        out += [("-", k + head, j + head) for k in range(i, x)] + [("+", x + head, k + head) for k in range(j, y)]
        if x < len(a) or y < len(b):
            out.append((" ", x + head, y + head))
        i, j = x + 1, y + 1
    return out + [(" ", len(old) - tail + k, len(new) - tail + k) for k in range(tail)]


#: Edits of a search that keeps all its steps, at least 1; one with more is split at its middle, which needs two rows only.
MOST_EDITS = 1024


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence: the greedy search by edits, split at its middle where it takes many."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    far, trail = {1: 0}, []
    for d in range(min(n + m, MOST_EDITS) + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                return _traced(n, m, [*trail, far], d)
        trail.append({k: far[k] for k in range(-d, d + 1, 2) if k in far})
    x, y, u, v = _middle(a, b)
    return _matches(a[:x], b[:y]) + [(x + k, y + k) for k in range(u - x)] + [(u + p, v + q) for p, q in _matches(a[u:], b[v:])]


def _traced(n: int, m: int, trail: list[dict[int, int]], edits: int) -> list[tuple[int, int]]:
    """The matches on the way back through what each number of edits reached."""
    out = []
    x, y = n, m
    for d in range(edits, 0, -1):
        was, k = trail[d - 1], x - y
        before = k + 1 if k == -d or (k != d and was.get(k - 1, -1) < was.get(k + 1, -1)) else k - 1
        px = was[before]
        start = px if before == k + 1 else px + 1
        out += [(i, i - k) for i in range(x - 1, start - 1, -1)]
        x, y = px, px - before
    out += [(i, i) for i in range(x - 1, -1, -1)]
    return out[::-1]


def _middle(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """The run of matches ``(from a, from b, to a, to b)`` in the middle of a shortest edit, searched from both ends."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for far, other, back in ((ahead, behind, False), (behind, ahead, True)):
            for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
                x = start = far[k + 1] if k == -d or (k != d and far.get(k - 1, -1) < far.get(k + 1, -1)) else far[k - 1] + 1
                while x < n and x - k < m and (a[n - 1 - x] == b[m - 1 - x + k] if back else a[x] == b[x - k]):
                    x += 1
                far[k] = x
                # the ends meet after an odd number of edits on the way ahead, after an even one on the way back
                reach = d if back else d - 1
                if (delta % 2 == 1) != back and abs(delta - k) <= reach and (delta - k) in other and x + other[delta - k] >= n:
                    return (n - x, m - (x - k), n - start, m - (start - k)) if back else (start, start - k, x, x - k)
    raise AssertionError("the ends always meet")


def unified(old: str, new: str, context: int = CONTEXT) -> str:
    """Hunks of a unified diff, without the header of the files."""
    a, b = _ended_lines(old), _ended_lines(new)
    script = edit_script(a, b)
    changed = [k for k, (op, _, _) in enumerate(script) if op != " "]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][-1] - 1 <= 2 * context:
            groups[-1].append(k)
        else:
            groups.append([k])
    out = []
    for g in groups:
        lo, hi = max(0, g[0] - context), min(len(script), g[-1] + context + 1)
        part = script[lo:hi]
        first_a, first_b = part[0][1], part[0][2]
        count_a, count_b = sum(op != "+" for op, _, _ in part), sum(op != "-" for op, _, _ in part)
        out.append(f"@@ -{first_a + (count_a > 0)},{count_a} +{first_b + (count_b > 0)},{count_b} @@")
        for op, i, j in part:
            line = b[j] if op == "+" else a[i]
            out.append(op + line.removesuffix("\n"))
            if not line.endswith("\n"):
                out.append("\\ No newline at end of file")
    return "".join(x + "\n" for x in out)


def pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, old_content, new_content, old_mode, new_mode`` of the paths that differ."""
    a = old.select("path", F.col("content").alias("old_content"), F.col("oid").alias("o1"), F.col("mode").alias("old_mode"))
    b = new.select("path", F.col("content").alias("new_content"), F.col("oid").alias("o2"), F.col("mode").alias("new_mode"))
    j = a.join(b, "path", "full_outer").where(~(F.col("o1").eqNullSafe(F.col("o2")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))))
    return j.select("path", "old_content", "new_content", "old_mode", "new_mode")


def stats(changed: DataFrame) -> DataFrame:
    """``path, additions, deletions, binary``: lines of a shortest edit script; 0 for binary files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            adds, dels = [], []
            for old, new, binary in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                script = [] if binary else edit_script(_ended_lines(old or ""), _ended_lines(new or ""))
                adds.append(sum(op == "+" for op, _, _ in script))
                dels.append(sum(op == "-" for op, _, _ in script))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(adds, pa.int64()), pa.array(dels, pa.int64()), batch.column(3)], names=["path", "additions", "deletions", "binary"])

    binary = F.coalesce(K.has_nul("old_content", K.PATCH_WINDOW), F.lit(False)) | F.coalesce(K.has_nul("new_content", K.PATCH_WINDOW), F.lit(False))
    return changed.select("path", "old_content", "new_content", binary.alias("binary")).mapInArrow(run, "path string, additions long, deletions long, binary boolean")


def histogram(rows: DataFrame, width: int = 40) -> DataFrame:
    """``path, bar``: plus and minus signs in proportion, at most ``width``; few totals pass, none is gathered."""
    most = F.broadcast(rows.agg(F.max(F.col("additions") + F.col("deletions")).alias("most")))  # one row
    scale = F.least(F.lit(1.0), F.lit(float(width)) / F.greatest("most", F.lit(1)))
    bar = lambda c, s: F.repeat(F.lit(s), F.ceil(F.col(c) * scale).cast("int"))
    return rows.join(most, F.lit(True)).select("path", F.concat(bar("additions", "+"), bar("deletions", "-")).alias("bar"))


def patches(changed: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``path, patch``: a whole section per file with header, mode lines and hunks; binary files only say that they
    differ.  Expects ``kind`` (Added, Deleted, Modified, Renamed, ...) and ``from`` beside the columns of ``pairs``."""
    a = P.quoted("a/", F.coalesce("from", "path"))
    b = P.quoted("b/", "path")
    octal = lambda m: F.lpad(F.conv(F.col(m).cast("string"), 10, 8), 6, "0")
    modes = (
        F.when(F.col("kind") == "Added", F.concat(F.lit("new file mode "), octal("new_mode"), F.lit("\n")))
        .when(F.col("kind") == "Deleted", F.concat(F.lit("deleted file mode "), octal("old_mode"), F.lit("\n")))
        .when(F.col("kind") == "Renamed", F.concat(F.lit("rename from "), F.col("from"), F.lit("\nrename to "), F.col("path"), F.lit("\n")))
        .when(F.col("old_mode") != F.col("new_mode"), F.concat(F.lit("old mode "), octal("old_mode"), F.lit("\nnew mode "), octal("new_mode"), F.lit("\n")))
        .otherwise("")
    )
    old, new = F.coalesce("old_content", F.lit("")), F.coalesce("new_content", F.lit(""))
    binary = K.has_nul(old, K.PATCH_WINDOW) | K.has_nul(new, K.PATCH_WINDOW)
    sides = F.concat(F.lit("--- "), F.when(F.col("kind") == "Added", "/dev/null").otherwise(a), F.lit("\n+++ "), F.when(F.col("kind") == "Deleted", "/dev/null").otherwise(b), F.lit("\n"))
    head = F.concat(F.lit("diff --git "), a, F.lit(" "), b, F.lit("\n"), modes)
    note = F.concat(F.lit("Binary files "), a, F.lit(" and "), b, F.lit(" differ\n"))
    rows = changed.select("path", old.alias("old"), new.alias("new"), head.alias("head"), F.when(old == new, "").when(binary, note).otherwise(sides).alias("sides"), ((old != new) & ~binary).alias("hunks"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            path, olds, news, heads, sides_, hunks = (c.to_pylist() for c in batch.columns)
            text = [h + s + (unified(o, n, context) if go else "") for o, n, h, s, go in zip(olds, news, heads, sides_, hunks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(text, pa.string())], names=["path", "patch"])

    return rows.mapInArrow(run, "path string, patch string")


def capped(rows: DataFrame, limit: int = PATCH_BYTES) -> tuple[DataFrame, bool]:
    """The sections in path order that fit ``limit`` bytes together, and whether some did not."""
    limit = min(limit, MOST_PATCH_BYTES)
    summed = with_sum_before(rows.withColumn("n", F.octet_length("patch").cast("long")), ["path"], "n", "before").withColumn("up_to", F.col("before") + F.col("n"))
    total = summed.agg(F.max("up_to")).first()[0] or 0
    return summed.where(F.col("up_to") <= limit).select("path", "patch").orderBy("path"), total > limit


def blame(versions: DataFrame) -> DataFrame:
    """``path, start, lines, version, orig_start`` of each file's last version; see :mod:`revlake.operators.blame`."""
    from revlake.operators.blame import blame as run

    return run(versions)


def blame_lines(hunks: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """A row per line of blame hunks, within an inclusive range."""
    line = hunks.select("path", "version", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("p", "line"), "orig_start")
    out = line.select("path", "line", "version", (F.col("orig_start") + F.col("p")).alias("orig_line"))
    return out.where(F.col("line") >= first) if last is None else out.where(F.col("line").between(first, last))


def hunk_groups(changes: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``path, hunk, first, last`` from changed line numbers (``path, line``): a gap above twice the context starts a new hunk."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line")
    gap = F.col("line") - F.lag("line").over(w) - 1 > 2 * context
    numbered = changes.withColumn("new", F.coalesce(gap, F.lit(True)).cast("long")).withColumn("hunk", F.sum("new").over(w))
    return numbered.groupBy("path", "hunk").agg(F.min("line").alias("first"), F.max("line").alias("last"))

"""Search patterns: what the driver knows about them before a job runs, and trigrams of content.

``required_literals`` answers with alternatives of which any match must contain at least one, or None where nothing can
be said.  It only has to be sound: a weaker answer costs candidates, never matches.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions import regex as X
from revlake.functions.paths import col
from revlake.functions.regex import InvalidPattern  # noqa: F401  (raised here)

#: Fixed limits of the analysis.
SHORTEST, MOST = 3, 32
#: Bytes that a task takes apart, and returns, at a time.
STEP = 1 << 20


def tree(pattern: str, literal: bool = False, fold: bool = False) -> tuple:
    return ("cat", tuple(("lit", c, fold) for c in pattern)) if literal else X.parse(pattern, fold)


def java_regex(pattern: str, literal: bool = False, fold: bool = False) -> str:
    """The one pattern that decides what matches; properties that the engine does not know are refused."""
    text = X.java(tree(pattern, literal, fold))
    context = SparkContext._active_spark_context
    if context is not None and not literal:
        from py4j.protocol import Py4JJavaError

        try:
            context._jvm.java.util.regex.Pattern.compile(text)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise InvalidPattern(f"{pattern!r}: {str(e).splitlines()[0]}") from None
    return text


def check(pattern: str) -> None:
    """Refuse what linear-time engines do not offer and what nothing understands."""
    java_regex(pattern)


def required_literals(pattern: str, literal: bool = False, fold: bool = False) -> list[str] | None:
    if literal:
        found: list[str] | None = [pattern]
    else:
        try:
            found = X.literals(X.parse(pattern))
        except InvalidPattern:
            return None
    if not found or len(found) > MOST or any(len(x.encode()) < SHORTEST for x in found):
        return None
    # a folded "k" or "s" also matches one letter outside ASCII, which no ASCII trigram finds
    if fold and any(not x.isascii() or set(x.lower()) & set("ks") for x in found):
        return None
    return list(dict.fromkeys(found))


def pack(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def trigrams(text: str) -> list[int]:
    """Distinct packed byte trigrams of a literal, in order."""
    b = text.encode()
    return sorted({pack(b[i : i + 3]) for i in range(len(b) - 2)})


def case_variants(trigram: int) -> list[int]:
    """The trigram under every ASCII case of its letters."""
    out = {b""}
    for byte in trigram.to_bytes(3, "big"):
        c = chr(byte)
        both = {byte, ord(c.upper()), ord(c.lower())} if c.isascii() and c.isalpha() else {byte}
        out = {x + bytes([b]) for x in out for b in both}
    return sorted(pack(x) for x in out)


def trigram_column(content: Column | str) -> Column:
    """Distinct packed byte trigrams of a (short) content column, as an expression."""
    c = col(content).cast("binary")
    n = F.octet_length(c)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.conv(F.hex(F.substring(c, i, F.lit(3))), 16, 10).cast("int")))


def parts(batch, column: int):
    """Slices of an Arrow batch with about ``STEP`` bytes of a column each, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
        yield batch.slice(start, end - start)
        start = end


def _distinct_trigrams(content: bytes):
    """Arrays of at most ``STEP`` that together hold each trigram of a content once; a long one is read in steps."""
    import numpy as np

    b = np.frombuffer(content, np.uint8)
    packed = lambda w: w[:-2] << 16 | w[1:-1] << 8 | w[2:]
    if len(b) <= STEP:
        if len(b) >= 3:
            yield np.unique(packed(b.astype(np.int32)))
        return
    seen = np.zeros(1 << 24, bool)  # a flag for each trigram there is
    for at in range(0, len(b) - 2, STEP):
        seen[packed(b[at : at + STEP + 2].astype(np.int32))] = True
    for at in range(0, len(seen), STEP):
        yield (np.flatnonzero(seen[at : at + STEP]) + at).astype(np.int32)


def trigram_rows(blobs: DataFrame, key: str = "blob_key", content: str = "content") -> DataFrame:
    """``trigram, blob_key``: the distinct byte trigrams of every blob, by numpy over Arrow batches.

    Beside the batch, which Spark bounds in rows and bytes, a task holds some times ``STEP``, however long a blob is.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(grams, keys):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(keys))], names=["trigram", "blob_key"])

        for batch in batches:
            for part in parts(batch, 1):
                keys, grams, held = [], [], 0
                for k, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    for g in _distinct_trigrams(c or b""):
                        if held and held + len(g) > STEP:
                            yield table(grams, keys)
                            keys, grams, held = [], [], 0
                        grams.append(g)
                        keys.append(np.full(len(g), k, np.int64))
                        held += len(g)
                if held:
                    yield table(grams, keys)

    return blobs.select(F.col(key).cast("long"), F.col(content).cast("binary")).where(f"{key} is not null").mapInArrow(run, "trigram int, blob_key long")

"""Content identity, classification, pointers and lines, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.globs import matches
from revlake.functions.paths import col

#: Fixed limits: searchable bytes, the window for NUL in search and in patches, bytes of a pointer file.
MAX_SEARCHABLE, SEARCH_WINDOW, PATCH_WINDOW, MAX_POINTER = 8 << 20, 8192, 8000, 1024
#: Paths that count as vendored or generated, in the grammar of path globs.
VENDORED = ("vendor/", "vendored/", "third_party/", "thirdparty/", "node_modules/", "external/")
GENERATED = (
    "*.min.js", "*.min.css", "*.map", "*_pb2.py", "*_pb.go", "*.pb.go", "*.pb.cc", "*.pb.h", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum",
)


def blob_oid(content: Column | str) -> Column:
    """Git's object id of a blob, with the algorithm in front."""
    c = col(content).cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(c).cast("string")).cast("binary")
    return F.concat(F.lit("sha1:"), F.sha1(F.concat(head, F.unhex(F.lit("00")), c)))


def has_nul(content: Column | str, window: int) -> Column:
    return F.instr(F.substring(col(content).cast("binary"), 1, window).cast("string"), "\0") > 0


def classify(content: Column | str, limit: int = MAX_SEARCHABLE) -> Column:
    """OVERSIZED, BINARY, INVALID_UTF8 or TEXT; null content was not examined and has no class."""
    c = col(content).cast("binary")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.octet_length(c) > limit, "OVERSIZED")
        .when(has_nul(c, SEARCH_WINDOW), "BINARY")
        .when(~F.is_valid_utf8(c.cast("string")), "INVALID_UTF8")
        .otherwise("TEXT")
    )


def classify_path(path: Column | str, vendored=VENDORED, generated=GENERATED) -> Column:
    out = None
    for kind, globs in (("VENDORED", vendored), ("GENERATED", generated)):
        for g in globs:
            out = F.when(matches(path, g), kind) if out is None else out.when(matches(path, g), kind)
    return out.otherwise("ORDINARY") if out is not None else F.lit("ORDINARY")


@dataclass(frozen=True)
class CorpusPolicy:
    """What is left out of a search; large files pointers always are."""

    binary: bool = True
    oversized: bool = True
    invalid_utf8: bool = False
    vendored: bool = False
    generated: bool = False

    def declared(self) -> list[str]:
        flags = (("binary", self.binary), ("oversized", self.oversized), ("invalid_utf8", self.invalid_utf8), ("generated", self.generated), ("vendored", self.vendored), ("lfs", True))
        return [n for n, on in flags if on]

    def reason(self, content_class: Column | str, path_class: Column | str, indexed: Column | str) -> Column:
        """Why a path is excluded, null where it is eligible; the first that holds counts."""
        c, p = col(content_class), col(path_class)
        out = F.when(c.isNull(), "index_gap")
        for kind, on in (("BINARY", self.binary), ("OVERSIZED", self.oversized), ("INVALID_UTF8", self.invalid_utf8), ("LFS", True)):
            if on:
                out = out.when(c == kind, kind.lower())
        for kind, on in (("VENDORED", self.vendored), ("GENERATED", self.generated)):
            if on:
                out = out.when(p == kind, kind.lower())
        return out.when(~F.coalesce(col(indexed), F.lit(False)), "index_gap")


def pointer(content: Column | str) -> Column:
    """``struct<oid, size>`` of a large-file pointer, null for anything else: at most 1024 bytes, the version line
    first, every line ended and of the form ``key value``; unknown keys are fine."""
    c = col(content).cast("string")
    lines = F.split(c, "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    fine = (
        (F.octet_length(c) <= MAX_POINTER)
        & F.endswith(c, F.lit("\n"))
        & F.element_at(lines, 1).rlike(r"\Aversion https://(?:git-lfs|hawser)\.github\.com/spec/v1\z")
        & F.forall(rest, lambda x: x.contains(" "))
    )
    oid = F.regexp_extract(c, r"(?m)^oid sha256:([0-9a-f]{64})$", 1)
    size = F.regexp_extract(c, r"(?m)^size ([0-9]{1,18})$", 1)
    return F.when(fine & (oid != "") & (size != ""), F.struct(F.concat(F.lit("lfs-sha256:"), oid).alias("oid"), size.cast("long").alias("size")))


def pointer_text(oid_hex: Column | str, size: Column | str) -> Column:
    return F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), col(oid_hex), F.lit("\nsize "), col(size).cast("string"), F.lit("\n"))


def lines(content: Column | str) -> Column:
    """Lines without their newline; no line after a final newline, none in an empty text; ``\\r`` stays."""
    parts = F.split(col(content).cast("string"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def locate(content: Column | str, offset: Column | str) -> Column:
    """``struct<line, column>`` (both from 1) of a byte offset."""
    head = F.substring(col(content).cast("binary"), F.lit(1), col(offset)).cast("string")
    last = F.element_at(F.split(head, "\n"), -1)
    return F.struct((F.size(F.split(head, "\n"))).cast("long").alias("line"), (F.octet_length(last) + 1).cast("long").alias("column"))


def utf8_cut(text: Column | str, limit: int) -> Column:
    """At most ``limit`` bytes of a text, never inside a character."""
    raw = col(text).cast("binary")
    cut = F.when(F.octet_length(raw) <= limit, F.lit(limit))
    for k in range(4):
        follow = F.conv(F.hex(F.substring(raw, limit + 1 - k, 1)), 16, 10).cast("int")
        cut = cut.when(F.shiftright(follow, 6) != 2, F.lit(limit - k))
    return F.substring(raw, F.lit(1), cut.otherwise(F.lit(limit))).cast("string")

"""Byte-path algebra as columns: components, ancestors, scopes, validity, order keys, quoting, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits of a path.
MAX_PATH_BYTES, MAX_COMPONENTS = 4096, 256


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def components(path: Column | str) -> Column:
    """The parts between slashes; the root (empty path) has none."""
    p = col(path)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, "/"))


def parent_of(path: Column | str) -> Column:
    """The path without its last component; a top-level entry and the root have the root as parent."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def join(parent: Column | str, name: Column | str) -> Column:
    return F.when(col(parent) == "", col(name)).otherwise(F.concat(col(parent), F.lit("/"), col(name)))


def depth(path: Column | str) -> Column:
    return F.size(components(path))


def ancestors_of(path: Column | str) -> Column:
    """Proper ancestors below the root, from the top down."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )


def is_within(path: Column | str, directory: Column | str) -> Column:
    """Strictly below ``directory``; everything is below the root."""
    p, d = col(path), col(directory)
    return F.when(d == "", p != "").otherwise(F.startswith(p, F.concat(d, F.lit("/"))))


def within_scope(path: Column | str, scope: str) -> Column:
    """Inside a scope or equal to it; as a range on the path, so that a sorted scan is pruned."""
    p = col(path)
    if scope == "":
        return F.lit(True)
    return (p == scope) | ((p >= scope + "/") & (p < scope + "0"))


def common_ancestor(a: Column | str, b: Column | str) -> Column:
    """The deepest directory path that both share, on component boundaries."""
    x, y = components(a), components(b)
    n = F.least(F.size(x), F.size(y))
    step = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.filter(step, lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))
    return F.coalesce(F.array_join(F.slice(x, 1, F.coalesce(F.array_max(same), F.lit(0))), "/"), F.lit(""))


def sort_key(name: Column | str, is_directory: Column) -> Column:
    """Order of entries inside one tree: directories compare as if their name ended in a slash."""
    return F.concat(col(name), F.when(is_directory, F.lit("/")).otherwise(F.lit("")))


def condition(path: Column | str) -> Column:
    """Null for a valid relative path, else why it is refused."""
    p = col(path)
    parts = F.split(p, "/")
    return (
        F.when(p == "", F.lit(None).cast("string"))
        .when(F.startswith(p, F.lit("/")), "absolute")
        .when(F.instr(p, "\0") > 0, "nul")
        .when(F.exists(parts, lambda c: c == ""), "empty component")
        .when(F.exists(parts, lambda c: c.isin(".", "..")), "dot component")
        .when(F.octet_length(p) > MAX_PATH_BYTES, "too long")
        .when(F.size(parts) > MAX_COMPONENTS, "too deep")
    )


def resolved(path: Column | str) -> Column:
    """``.`` and ``..`` worked out; null where the path climbs above the root."""
    parts = F.filter(F.split(col(path), "/"), lambda c: ~c.isin("", "."))
    start = F.array().cast("array<string>")
    # a null accumulator marks a path that left the root, and stays null
    walked = F.aggregate(
        parts,
        start,
        lambda acc, c: F.when(acc.isNull(), acc).when(c != "..", F.concat(acc, F.array(c))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.when(walked.isNotNull(), F.array_join(walked, "/"))


def quoted(prefix: str, path: Column | str) -> Column:
    """A path as patches show it: plain, or in C quotes when a byte needs an escape."""
    return _quote(F.concat(F.lit(prefix), col(path)).cast("binary"))


def _quote(raw: Column) -> Column:
    # a character for each byte, so one pass of a regular expression sets apart those that need an escape
    text = F.decode(raw, "ISO-8859-1")
    odd = r'[\x00-\x1f"\\\x7f-\xff]'
    named = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
    codes = F.split(F.lit(" ".join(named.get(c, f"\\{c:03o}") for c in range(256))), " ")
    pieces = F.split(text, f"(?<={odd})|(?={odd})")
    shown = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"\A{odd}\z"), F.element_at(codes, F.ascii(p) + 1)).otherwise(p)), "")
    return F.when(text.rlike(odd), F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(raw.cast("string"))


def escaped(raw: Column | str) -> Column:
    """Lossless display of a byte path: valid UTF-8 stays (a backslash is doubled), other bytes become ``\\xHH``."""
    r = col(raw)
    text = r.cast("string")
    hexes = F.when(F.octet_length(r) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(r)), lambda i: F.substring(r, i, F.lit(1))))
    bytewise = F.transform(
        hexes, lambda b: F.when((F.hex(b) >= "20") & (F.hex(b) < "7F"), F.replace(b.cast("string"), F.lit("\\"), F.lit("\\\\"))).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(b))))
    )
    return F.when(F.octet_length(r) == 0, "").when(F.is_valid_utf8(text), F.replace(text, F.lit("\\"), F.lit("\\\\"))).otherwise(F.array_join(bytewise, ""))


def base64url(raw: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.base64(col(raw)), "+/", "-_"), "=+$", "")


def from_base64url(text: Column | str) -> Column:
    t = F.translate(col(text), "-_", "+/")
    return F.unbase64(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "="))


def repository_id_for(url: Column | str) -> Column:
    """An identifier from an upstream URL; null where nothing is left."""
    u = F.trim(col(url))
    u = F.regexp_replace(u, "^.*?://", "")
    u = F.regexp_replace(u, "^.*@", "")
    u = F.regexp_replace(F.translate(u, ":", "/"), "^/+|/+$", "")
    u = F.regexp_replace(u, "\\.git$", "")
    u = F.regexp_replace(F.regexp_replace(u, "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")
    u = F.regexp_replace(F.regexp_replace(u, "^\\.+|\\.+$", ""), "\\.\\.", "._")
    return F.when(u != "", u)


def directory_for(url: Column | str) -> Column:
    """The directory name a checkout of a URL gets: the last part of the path without ``.git``."""
    u = F.regexp_replace(F.regexp_replace(F.trim(col(url)), "/+$", ""), "\\.git$", "")
    return F.regexp_extract(u, "([^/:]+)$", 1)


def work_ref(subject: Column | str, branch: Column | str, namespace: str) -> Column:
    """The reserved ref of a subject's branch; the subject is folded to characters a ref may hold."""
    s = F.regexp_replace(col(subject), "[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "^_+|_+$", ""), "^\\.+|\\.+$", "")
    return F.concat(F.lit(namespace), F.when(s == "", "anonymous").otherwise(s), F.lit("/"), col(branch))


def valid_identifier(value: Column | str, longest: int = 64) -> Column:
    """Letters, digits, dot, dash and underscore, led by a letter or digit, without two dots in a row."""
    v = col(value)
    return v.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~v.contains("..") & (F.length(v) <= longest)


def valid_branch(value: Column | str) -> Column:
    """Names a branch may have."""
    v = col(value)
    bad = v.rlike(r"[\x00-\x20\x7f~^:?*\[\\]") | v.contains("..") | v.contains("//") | v.contains("@{") | v.rlike(r"(^|/)\.") | v.rlike(r"\.lock(/|\z)")
    return (v != "") & (v != "@") & ~bad & ~v.rlike(r"^[-/]|[/.]\z")


def is_reserved_ref(name: Column | str, reserved: str) -> Column:
    """In the reserved namespace, in its long or its short spelling."""
    n = col(name)
    return F.startswith(n, F.lit(reserved)) | F.startswith(F.concat(F.lit("refs/"), n), F.lit(reserved))


def xml_escape(text: Column | str) -> Column:
    t = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def percent_encode(path: Column | str) -> Column:
    """Bytes outside ``A-Za-z0-9-._~/`` as ``%HH``."""
    e = F.url_encode(col(path))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e

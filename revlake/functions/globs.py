"""Glob patterns compiled on the driver to one regular expression each, so that matching stays in generated code.

Grammar of path globs: ``?`` and ``*`` stop at a slash, ``**`` crosses slashes (with a slash behind it swallowed),
``[...]`` is a class that never matches a slash, a backslash takes the next character as it is, a leading slash anchors,
a trailing slash asks for a directory, and a pattern without an inner slash is matched against single components.
The grammar of ``find`` lets ``*`` and ``?`` cross slashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.paths import col


def _quote(c: str) -> str:
    return c if c.isalnum() or c in "_/ " or ord(c) > 127 else "\\" + c


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The class that opens at ``glob[at]``, and the place behind it; None where it never closes."""
    end = at + 1
    negated = end < len(glob) and glob[end] in "!^"
    end += negated
    first = end
    while end < len(glob) and (glob[end] != "]" or end == first):
        end += 1
    if end >= len(glob):
        return None
    body = "".join(c if c == "-" else _quote(c) for c in glob[first:end])
    return f"[{'^' * negated}{body}]", end + 1


def _body(glob: str, star: str, double: str, one: str, guard: str) -> str:
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            many = glob.startswith("**", at)
            while at < len(glob) and glob[at] == "*":
                at += 1
            if many:
                at += glob.startswith("/", at)
            out.append(double if many else star)
        elif c == "?":
            out.append(one)
            at += 1
        elif c == "[" and (found := _class(glob, at)):
            out.append(guard + found[0])
            at = found[1]
        elif c == "\\" and at + 1 < len(glob):
            out.append(_quote(glob[at + 1]))
            at += 2
        else:
            out.append(_quote(c))
            at += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """The regular expression of a path glob, to be searched for in the whole path."""
    directory = glob.endswith("/") and not glob.endswith("\\/")
    anchored = glob.startswith("/")
    core = glob.strip("/") if directory else glob[1:] if anchored else glob
    if anchored or "/" in core:
        rx = _body(core, "[^/]*", ".*", "[^/]", "(?!/)")
        return rf"(?s)\A(?:{rx})" + ("(?:/|\\z)" if directory else "\\z")
    rx = _body(core, "[^/]*", "[^/]*", "[^/]", "(?!/)")
    return rf"(?s)(?:\A|/)(?:{rx})" + ("/" if directory else "(?:/|\\z)")


def fnmatch_regex(pattern: str) -> str:
    """The regular expression of a ``find`` pattern, for the whole value."""
    return rf"(?s)\A(?:{_body(pattern, '.*', '.*', '.', '')})\z"


def matches(path: Column | str, glob: str) -> Column:
    return col(path).rlike(glob_regex(glob))


def fnmatch(value: Column | str, pattern: str, fold: bool = False) -> Column:
    v = F.lower(col(value)) if fold else col(value)
    return v.rlike(fnmatch_regex(pattern.lower() if fold else pattern))


def selected(path: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any of ``include`` (all, if empty) and none of ``exclude``."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for g in include:
            keep = keep | matches(path, g)
    for g in exclude:
        keep = keep & ~matches(path, g)
    return keep


def for_python(rx: str) -> str:
    return rx.replace("\\z", "\\Z")


def is_match(path: str, glob: str) -> bool:
    """The same test on the driver."""
    return re.search(for_python(glob_regex(glob)), path) is not None

"""Command lines turned into queries: what search and find tools are called with, refused where it is not understood."""

from __future__ import annotations

import argparse

from revlake.operators.search import Query


class Refused(ValueError):
    """An option that has no exact counterpart."""


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Refused(message)


def search_query(argv: list[str]) -> Query:
    """A search from the options of line search tools: fixed or regular pattern, case, globs, context, most results."""
    p = _Parser(add_help=False, allow_abbrev=False)
    p.add_argument("-F", "--fixed-strings", action="store_true")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-n", "--line-number", action="store_true")
    p.add_argument("-g", "--glob", action="append", default=[])
    p.add_argument("-A", "--after-context", type=int, default=0)
    p.add_argument("-B", "--before-context", type=int, default=0)
    p.add_argument("-C", "--context", type=int)
    p.add_argument("-m", "--max-count", type=int, default=0)
    p.add_argument("-e", "--regexp")
    p.add_argument("rest", nargs="*")
    a = p.parse_args(argv)
    rest = list(a.rest)
    pattern = a.regexp if a.regexp is not None else rest.pop(0) if rest else None
    if pattern is None or len(rest) > 1:
        raise Refused("one pattern and at most one path")
    around = (a.before_context, a.after_context) if a.context is None else (a.context, a.context)
    return Query(
        pattern, a.fixed_strings, a.ignore_case, (rest[0] if rest else "").strip("/").removeprefix("./"),
        tuple(g for g in a.glob if not g.startswith("!")), tuple(g[1:] for g in a.glob if g.startswith("!")), None, a.max_count, around,
    ).clamped()


def find_options(argv: list[str]) -> dict:
    """Keyword arguments of ``find``: a start and tests that must all hold; an unknown test is refused by its name."""
    out: dict = {}
    words = list(argv)
    if words and not words[0].startswith("-"):
        out["start"] = words.pop(0).strip("/").removeprefix("./")
        out["start"] = "" if out["start"] == "." else out["start"]
    names = {"-name": "name", "-iname": "iname", "-path": "path", "-wholename": "path", "-type": "kind", "-mindepth": "mindepth", "-maxdepth": "maxdepth"}
    while words:
        w = words.pop(0)
        if w == "-print":
            continue
        if w not in names or not words:
            raise Refused(w)
        value = words.pop(0)
        if w == "-type" and value not in ("f", "d"):
            raise Refused(f"-type {value}")
        out[names[w]] = int(value) if w.endswith("depth") else value
    return out


def diff_arguments(argv: list[str]) -> tuple[str | None, str | None]:
    """``(old, new)`` revisions: none is the pin against the workspace, one against the pin, two or ``a..b`` each other."""
    if len(argv) == 1 and ".." in argv[0]:
        old, _, new = argv[0].partition("..")
        if not old or not new or new.startswith("."):
            raise Refused(argv[0])
        return old, new
    if len(argv) > 2 or any(".." in a for a in argv):
        raise Refused(" ".join(argv))
    return (*argv, None, None)[:2] if argv else (None, None)

"""Boolean trigram queries derived from regular expressions."""

from __future__ import annotations

import re._constants as C
import re._parser as parser

ANY = ("any",)


def _all(parts: list) -> tuple:
    kept = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def _one_of(parts: list) -> tuple:
    return ANY if ANY in parts or not parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _literal(run: str) -> tuple:
    return _all([("tri", run[i : i + 3].lower()) for i in range(len(run) - 2)])


def _walk(items) -> tuple:
    found, run = [], ""
    for op, arg in items:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        found.append(_literal(run))
        run = ""
        if op is C.BRANCH:
            found.append(_one_of([_walk(x) for x in arg[1]]))
        elif op is C.SUBPATTERN:
            found.append(_walk(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found.append(_walk(arg[2]))
    return _all([*found, _literal(run)])


def trigram_query(pattern: str) -> tuple:
    """The query that every match of pattern must satisfy, over lower-cased trigrams: ("tri", t),
    ("and", ...), ("or", ...), or ANY where no trigram is mandatory."""
    return _walk(parser.parse(pattern))


def trigrams(query: tuple) -> list[str]:
    if query[0] == "tri":
        return [query[1]]
    return list(dict.fromkeys(t for q in query[1:] for t in trigrams(q)))

"""Tokens of a query, and the guard that lets only single reading statements through."""

from __future__ import annotations

import re


class QueryError(ValueError):
    """A query that can't be read, or isn't only reading."""


TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<number>(?:\d+\.\d+|\d+(?!\.\d))(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)|(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<op><>|<=|>=|=~|->|<-|\.\.|[-+*/%=<>()\[\]{}.,:|;])""",
    re.DOTALL,
)
# Fixed values of the language.
READS = {"MATCH", "OPTIONAL", "RETURN", "WITH", "UNWIND", "CALL", "EXPLAIN", "PROFILE"}
PROCEDURES = {"DB.LABELS", "DB.RELATIONSHIPTYPES", "DB.PROPERTYKEYS", "SHOW_TABLES", "TABLE_INFO", "SHOW_CONNECTION", "SHOW_FUNCTIONS", "CURRENT_SETTING"}
WRITES = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "ALTER", "COPY", "LOAD", "INSTALL", "ATTACH", "IMPORT", "EXPORT", "FOREACH", "RENAME", "USE", "BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "UNINSTALL"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read the query at {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


def check_read_only(text: str) -> list[tuple[str, str]]:
    """The tokens of a query that is one reading statement; else an error. Words in strings, comments and after a dot or
    colon don't count."""
    found = tokens(text)
    while found and found[-1] == ("op", ";"):
        found.pop()
    if not found or found[0][0] != "name" or found[0][1].upper() not in READS:
        raise QueryError("a query begins with MATCH, OPTIONAL MATCH, WITH, UNWIND, RETURN, CALL, EXPLAIN or PROFILE")
    for k, (kind, word) in enumerate(found):
        if (kind, word) == ("op", ";"):
            raise QueryError("one statement at a time")
        if kind == "name" and word.upper() in WRITES and found[k - 1][1] not in (".", ":", "|"):
            raise QueryError(f"{word.upper()} isn't reading")
        if kind == "name" and word.upper() == "CALL" and found[k - 1][1] not in (".", ":", "|"):
            end = next((n for n in range(k + 1, len(found)) if found[n][1] == "("), len(found))
            called = "".join(x[1] for x in found[k + 1 : end]).upper()
            if called not in PROCEDURES:
                raise QueryError(f"{called or 'CALL'} isn't a procedure that only reads")
    return found

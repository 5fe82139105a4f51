"""A check of vector columns in migrations: each must have an index that can hold and use it."""

from __future__ import annotations

import re

# The greatest dimension that an index of each type takes, and the operator class of its cosine distance.
INDEX_LIMITS = {"vector": (2000, "vector_cosine_ops"), "halfvec": (4000, "halfvec_cosine_ops")}
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", re.S)
_TABLE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*\(", re.I)
_ADDED = re.compile(r"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?([\w.]+)\s+add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(\w+)\s+(vector|halfvec)\s*\(\s*(\d+)\s*\)", re.I)
_COLUMN = re.compile(r"(?:^|,)\s*(\w+)\s+(vector|halfvec)\s*\(\s*(\d+)\s*\)", re.I)
_INDEX = re.compile(r"create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?\w*\s*on\s+([\w.]+)\s+using\s+(hnsw|ivfflat)\s*\(\s*(\w+)(?:\s+(\w+))?", re.I)


def _inside(text: str, start: int) -> str:
    """What stands between the parenthesis before ``start`` and the one that closes it."""
    depth = 1
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return text[start:i]
    return text[start:]


def lint_vectors(migrations: dict[str, str]) -> list[str]:
    """Faults of vector columns, over all migrations ``{name: SQL}`` in order of their names."""
    columns: dict[tuple[str, str], tuple[str, int, str]] = {}
    indexes: dict[tuple[str, str], list[str]] = {}
    for name in sorted(migrations):
        sql = _COMMENT.sub(" ", migrations[name])
        for m in _TABLE.finditer(sql):
            for c in _COLUMN.finditer(_inside(sql, m.end())):
                columns[m[1].lower(), c[1].lower()] = c[2].lower(), int(c[3]), name
        for m in _ADDED.finditer(sql):
            columns[m[1].lower(), m[2].lower()] = m[3].lower(), int(m[4]), name
        for m in _INDEX.finditer(sql):
            indexes.setdefault((m[1].lower(), m[3].lower()), []).append((m[4] or "").lower())
    faults = []
    for (table, column), (kind, dim, name) in sorted(columns.items()):
        most, wanted = INDEX_LIMITS[kind]
        if dim > most:
            faults.append(f"{name}: {table}.{column} has {dim} dimensions, an index of {kind} takes {most}")
        if (table, column) not in indexes:
            faults.append(f"{name}: {table}.{column} has no index")
        faults += [f"{name}: {table}.{column} is indexed by {used or 'the default class'}, not {wanted}" for used in indexes.get((table, column), []) if used != wanted]
    return faults

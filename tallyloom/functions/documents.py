"""JSON values: path diffs, apply and undo, text gathering."""

from __future__ import annotations

import json
from typing import Any

MISSING = object()


def diff(a: Any, b: Any, path: str = "") -> list[tuple[str, Any, Any]]:
    """(path, before, after) of what differs. Objects recurse by key, arrays
    only at equal length; MISSING is not null."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted({*a, *b}) for d in diff(a.get(k, MISSING), b.get(k, MISSING), f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [d for i, (x, y) in enumerate(zip(a, b)) for d in diff(x, y, f"{path}/{i}")]
    same = a is b or (type(a) is type(b) and a == b)
    return [] if same else [(path, a, b)]


def patch(value: Any, changes: list[tuple[str, Any, Any]], undo: bool = False) -> Any:
    """The value with changes applied, or undone; the input stays as it is."""
    out = json.loads(json.dumps(value))
    for path, before, after in changes:
        new = before if undo else after
        if path == "":
            out = new
            continue
        *way, last = (p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:])
        at = out
        for p in way:
            at = at[int(p)] if isinstance(at, list) else at[p]
        if isinstance(at, list):
            at[int(last)] = new
        elif new is MISSING:
            at.pop(last, None)
        else:
            at[last] = new
    return out


def gather_text(value: Any, keys: tuple[str, ...] = ("text", "content", "value")) -> str:
    """All strings under text keys, in order, joined by one space."""
    out: list[str] = []

    def walk(v: Any, wanted: bool) -> None:
        if isinstance(v, str) and wanted and v.strip():
            out.append(v.strip())
        elif isinstance(v, dict):
            for k, x in v.items():
                walk(x, k in keys or isinstance(x, (dict, list)) and wanted)
        elif isinstance(v, list):
            for x in v:
                walk(x, wanted)

    walk(value, True)
    return " ".join(out)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

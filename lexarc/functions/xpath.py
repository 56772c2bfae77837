"""A path subset: ``/a/b[@x='v']/@c``, ``//``, ``*``; elements are indexed by reversed path."""

from __future__ import annotations

import re

_STEP = re.compile(r"(//|/)(@?[\w.:*-]+)?(?:\[@([\w.:-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^\]]*)))?\])?")


def steps(path: str) -> list[tuple[bool, str, str | None]]:
    """(any depth before, name, predicate 'attr' or 'attr=value') of every step; ``/`` alone has none."""
    out, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"bad path {path!r}")
        at = m.end()
        if m[2]:
            value = next((v for v in m.groups()[3:] if v is not None), None)
            out.append((m[1] == "//", m[2], m[3] and (f"{m[3]}={value}" if value is not None else m[3])))
    return out


def region(path: list[tuple[bool, str, str | None]]) -> tuple[str, str | None, str | None]:
    """Pattern over reversed paths ``b/a/``, the attribute asked for, and the last step's predicate."""
    pattern, attribute = "", None
    for deep, name, _ in path:
        part = re.escape(name).replace(r"\*", "[^/]*") + "/"
        attribute = name[1:] if name.startswith("@") else None
        pattern = part + (r"(?:[^/]+/)*" if deep else "") + pattern
    return f"^{pattern}$", attribute, path[-1][2] if path else None


def regions(path: list[tuple[bool, str, str | None]]) -> list[tuple[str, str | None, str | None]]:
    """``region`` of the whole path and of every part up to a step with a predicate, innermost first."""
    return [region(path[: i + 1]) for i in range(len(path) - 1, -1, -1) if i == len(path) - 1 or path[i][2]]

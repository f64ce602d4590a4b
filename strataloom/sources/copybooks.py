"""Copybook expansion with the origin of every line."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_DEPTH = 64
_COPY = re.compile(r"^\s*COPY\s+[\"']?(?P<name>[A-Za-z0-9_-]+(?:\.[A-Za-z0-9]+)?)[\"']?(?P<rest>.*)$", re.IGNORECASE)
_PAIR = re.compile(r"==(?P<old>.*?)==\s+BY\s+==(?P<new>.*?)==", re.IGNORECASE)


class CopybookError(ValueError):
    """A copybook is missing, nested too deep, or includes itself."""


@dataclass(frozen=True)
class Line:
    text: str
    source: str
    number: int
    stack: tuple[str, ...] = ()
    replaced: tuple[tuple[str, str], ...] = ()


def _member(library: dict[str, str], name: str) -> str | None:
    by_upper = {k.upper(): v for k, v in library.items()}
    stem = name.upper().removesuffix(".CPY")
    return next((by_upper[k] for k in (name.upper(), stem, f"{stem}.CPY") if k in by_upper), None)


def expand(source: str, library: dict[str, str], name: str = "<main>", stack: tuple[str, ...] = (), replaced: tuple[tuple[str, str], ...] = ()) -> list[Line]:
    """The lines of a source with all COPY statements expanded, outermost replacements last.

    The first line of a member keeps its own indent, later ones get that of
    the COPY statement; comment lines are left alone.
    """
    if len(stack) > MAX_DEPTH:
        raise CopybookError(f"copybooks nest deeper than {MAX_DEPTH}")
    out: list[Line] = []
    for number, raw in enumerate(source.splitlines(), 1):
        body = raw[6:] if len(raw) > 6 and (raw[:6].isdigit() or raw[:6].isspace()) else raw
        comment = body.lstrip().startswith("*") or body[:1] in ("*", "/")
        found = None if comment else _COPY.match(body)
        if not found:
            out.append(Line(_replace(raw, replaced), name, number, stack, replaced))
            continue
        member = found["name"].upper().rstrip(".")
        if member in stack:
            raise CopybookError("copybooks include each other: " + " -> ".join((*stack, member)))
        text = _member(library, member)
        if text is None:
            raise CopybookError(f"copybook {member} not found")
        pairs = tuple((m["old"].strip(), m["new"].strip()) for m in _PAIR.finditer(found["rest"]))
        indent = raw[: len(raw) - len(raw.lstrip())]
        for k, line in enumerate(expand(text, library, member, (*stack, member), pairs + replaced)):
            moved = line.text if k == 0 or line.text.startswith(indent) else indent + line.text
            out.append(Line(moved, line.source, line.number, line.stack, line.replaced))
    return out


def _replace(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text

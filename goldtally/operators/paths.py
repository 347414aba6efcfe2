"""X11 over nested output: ``insured_objects[0].year`` as a Column, and the
assertions that use it.

A path is a column name, then ``.field`` and ``[index]`` steps (indexes from
0).  A step over a null or beyond a list's end gives null, never an error.
``validate.check_assertions`` counts a null predicate as a failure, so an
absent index fails ``equals`` and ``one_of``; ``is_none`` asks that the place
exists and holds null, so it fails there too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_]\w*")
_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[([0-9]+)\]")


def _steps(path: str) -> tuple[str, list[str | int]]:
    head = _NAME.match(path)
    if head is None:
        raise ValueError(f"a path starts with a column name: {path!r}")
    steps, at = [], head.end()
    while at < len(path):
        step = _STEP.match(path, at)
        if step is None:
            raise ValueError(f"no .field or [index] at {at} of {path!r}")
        steps.append(step[1] if step[1] is not None else int(step[2]))
        at = step.end()
    return head[0], steps


def _walk(path: str) -> list[Column]:
    """The values on the way along ``path``, its own last."""
    head, steps = _steps(path)
    values = [F.col(head)]
    for s in steps:
        values.append(F.get(values[-1], F.lit(s)) if isinstance(s, int) else values[-1].getField(s))
    return values


def at_path(path: str) -> Column:
    """The value at ``path``, null where a step has nothing to go to."""
    return _walk(path)[-1]


def equals(path: str, value) -> Column:
    return at_path(path) == F.lit(value)


def one_of(path: str, values) -> Column:
    return at_path(path).isin(list(values))


def length_is(path: str, n: int) -> Column:
    """The list at ``path`` has ``n`` elements (a null list has none to count, and fails)."""
    value = at_path(path)
    return F.when(value.isNotNull(), F.size(value) == n)


def is_none(path: str) -> Column:
    """The place exists (what holds it is there, an index is inside its list) and is null."""
    _, steps = _steps(path)
    values = _walk(path)
    if not steps:
        return values[-1].isNull()
    holder, last = values[-2], steps[-1]
    there = F.size(holder) > last if isinstance(last, int) else F.lit(True)
    return F.when(holder.isNotNull(), there & values[-1].isNull())

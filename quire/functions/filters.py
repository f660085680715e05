"""Filters of a collection, given as dictionaries, to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def _key(name: str, value, columns: list[str]) -> Column:
    """A typed column, else a key of the map `extra`, cast to the operand's type."""
    if name in columns:
        return F.col(name)
    one = next(iter(value), None) if isinstance(value, (list, tuple, set)) else value
    kind = "boolean" if isinstance(one, bool) else "bigint" if isinstance(one, int) else "double" if isinstance(one, float) else "string"
    return F.element_at("extra", name).try_cast(kind)


def where(spec: dict | None, columns: list[str]) -> Column:
    """Metadata filter: equality, comparisons, $in and $nin, $and and $or; several keys mean all. A missing key fits none."""
    if not spec:
        return F.lit(True)
    parts = []
    for name, value in spec.items():
        if name in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), [where(v, columns) for v in value]))
        elif isinstance(value, dict):
            parts += [_COMPARE[op](_key(name, v, columns), v) for op, v in value.items()]
        else:
            parts.append(_key(name, value, columns) == value)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def where_document(spec: dict | None, text: Column) -> Column:
    """Text filter: $contains, $not_contains, $and, $or; case counts."""
    if not spec:
        return F.lit(True)
    parts = []
    for op, value in spec.items():
        if op in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), [where_document(v, text) for v in value]))
        else:
            parts.append(text.contains(value) if op == "$contains" else ~text.contains(value))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

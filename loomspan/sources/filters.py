"""Filters written as documents ({"time": {"$gt": t}}) to columns, which Spark pushes into the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


def _one(column: Column, value: object) -> Column:
    if not isinstance(value, dict):
        return column == value
    if not value or any(op not in _COMPARE for op in value):
        raise NotImplementedError(f"no such condition: {value}")
    return reduce(Column.__and__, [_COMPARE[op](column, v) for op, v in value.items()])


def condition(query: dict, names: dict[str, str] | None = None) -> Column:
    """All parts of ``query`` must hold; "$or" takes a list of queries.  ``names`` maps its names to columns."""
    parts = []
    for key, value in query.items():
        if key == "$or":
            if not value:
                raise NotImplementedError("nothing to choose from")
            parts.append(reduce(Column.__or__, [condition(q, names) for q in value]))
        elif key.startswith("$"):
            raise NotImplementedError(f"no such condition: {key}")
        else:
            parts.append(_one(F.col((names or {}).get(key, key)), value))
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def order(sort: dict[str, int], names: dict[str, str] | None = None) -> list[Column]:
    """Columns to sort by from {"time": 1, "id": -1}."""
    if any(d not in (1, -1) for d in sort.values()):
        raise NotImplementedError("directions are 1 and -1")
    return [F.col((names or {}).get(k, k)).asc() if d == 1 else F.col((names or {}).get(k, k)).desc() for k, d in sort.items()]

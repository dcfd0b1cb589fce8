"""The typed query over vehicle records, and its checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: The operators that each field allows.
FIELD_OPERATORS = {
    "class": ("eq", "neq", "in", "not_in"),
    "colour": ("eq", "neq", "in", "not_in"),
    "camera": ("eq", "neq", "in", "not_in"),
    "run": ("eq", "neq", "in", "not_in"),
    "plate_text": ("eq", "starts_with", "ends_with", "contains", "exists", "not_exists"),
    "plate_detected": ("eq",),
    "plate_readable": ("eq",),
    "plate_presence": ("eq", "neq"),
    "start_time": ("gt", "gte", "lt", "lte", "between"),
    "end_time": ("gt", "gte", "lt", "lte", "between"),
    "vehicle_id": ("eq", "in"),
}
#: What records may be grouped by.
GROUPS = ("class", "colour", "camera", "run", "run_camera", "plate_presence", "time_bucket")


@dataclass(frozen=True)
class Filter:
    """A condition (field, operator, value), or and / or / not over parts; not means that none of its parts holds."""

    kind: str = "condition"
    field: str = ""
    operator: str = ""
    value: Any = None
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Query:
    """What is asked of vehicle records. An empty tuple restricts nothing."""

    filters: Filter | None = None
    runs: tuple[str, ...] = ()
    cameras: tuple[str, ...] = ()
    without_cameras: tuple[str, ...] = ()
    previous_ids: tuple[str, ...] = ()
    start: float | None = None
    end: float | None = None
    bucket_seconds: float = 5.0
    group_by: str = ""
    descending: bool | None = None
    limit: int | None = None
    errors: tuple[str, ...] = field(default=(), compare=False)


def where(name: str, operator: str, value: Any = None) -> Filter:
    return Filter(field=name, operator=operator, value=value)


def both(*parts: Filter) -> Filter:
    return Filter(kind="and", parts=parts)


def either(*parts: Filter) -> Filter:
    return Filter(kind="or", parts=parts)


def none_of(*parts: Filter) -> Filter:
    return Filter(kind="not", parts=parts)


def problems(query: Query) -> list[str]:
    """What a query asks that cannot be answered; empty if it is sound."""
    found = []

    def visit(f: Filter) -> None:
        if f.kind == "condition":
            if f.field not in FIELD_OPERATORS:
                found.append(f"unknown field {f.field}")
            elif f.operator not in FIELD_OPERATORS[f.field]:
                found.append(f"{f.field} does not allow {f.operator}")
        elif f.kind not in ("and", "or", "not"):
            found.append(f"unknown filter kind {f.kind}")
        for p in f.parts:
            visit(p)

    if query.filters:
        visit(query.filters)
    if query.group_by and query.group_by not in GROUPS:
        found.append(f"unknown group {query.group_by}")
    if query.bucket_seconds <= 0:
        found.append("bucket_seconds must be positive")
    if query.start is not None and query.end is not None and query.start > query.end:
        found.append("the time range is empty")
    return found


def from_payload(payload: dict[str, Any]) -> Query:
    """A query from JSON-like data; raises ValueError with all that is wrong."""

    def read(node: dict[str, Any] | None) -> Filter | None:
        if not node:
            return None
        if node.get("kind", "condition") == "condition":
            value = node.get("value")
            return where(str(node.get("field", "")), str(node.get("operator", "eq")), tuple(value) if isinstance(value, list) else value)
        return Filter(kind=str(node["kind"]), parts=tuple(p for x in node.get("conditions", []) if (p := read(x))))

    keys = {k: tuple(payload[k]) for k in ("runs", "cameras", "without_cameras", "previous_ids") if payload.get(k)}
    plain = {k: payload[k] for k in ("start", "end", "bucket_seconds", "group_by", "descending", "limit") if payload.get(k) is not None}
    query = Query(filters=read(payload.get("filters")), **keys, **plain)
    if wrong := problems(query):
        raise ValueError("; ".join(wrong))
    return query

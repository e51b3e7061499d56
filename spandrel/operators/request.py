"""The typed request that questions are compiled to."""

from __future__ import annotations

import re
from dataclasses import dataclass

# What a request can ask, of what, and how.
INTENTS = ("count", "list", "aggregate", "group")
SOURCES = ("element", "property", "quantity")
OPERATORS = ("eq", "neq", "lt", "lte", "gt", "gte", "like")
AGGREGATES = ("count", "sum", "avg", "min", "max")


def _safe(name: str) -> bool:
    """A field's name is of letters, digits, blanks and a few signs; quotes, escapes and control characters are refused."""
    return re.fullmatch(r"[\w .:/()%+&-]+", name) is not None and name.strip() != ""


@dataclass(frozen=True)
class Field:
    source: str
    name: str

    def __post_init__(self):
        if self.source not in SOURCES or not _safe(self.name):
            raise ValueError(f"no such field: {self.source} {self.name!r}")


@dataclass(frozen=True)
class Filter:
    source: str
    name: str
    op: str
    value: object

    def __post_init__(self):
        if self.source not in SOURCES or self.op not in OPERATORS or not _safe(self.name):
            raise ValueError(f"no such filter: {self.source} {self.name!r} {self.op}")


@dataclass(frozen=True)
class Request:
    intent: str
    ifc_class: str | None = None
    level: str | None = None
    predefined_type: str | None = None
    type_name: str | None = None
    text_match: str | None = None
    filters: tuple[Filter, ...] = ()
    aggregate_op: str | None = None
    aggregate_field: Field | None = None
    group_by: Field | None = None
    limit: int = 50

    def __post_init__(self):
        if self.intent not in INTENTS:
            raise ValueError(f"intent must be one of {INTENTS}")
        if self.intent == "aggregate":
            if self.aggregate_op not in AGGREGATES:
                raise ValueError(f"aggregate_op must be one of {AGGREGATES}")
            if self.aggregate_op != "count" and self.aggregate_field is None:
                raise ValueError("an aggregate other than count needs a field")
        if self.intent != "aggregate" and (self.aggregate_op or self.aggregate_field):
            raise ValueError("only an aggregate has an operator and a field")
        if self.intent != "group" and self.group_by is not None:
            raise ValueError("only group has group_by")
        if self.intent == "group" and self.group_by is None:
            raise ValueError("group needs group_by")
        if self.limit < 0:
            raise ValueError("limit must not be negative")

"""Plans: what a parsed request asks for. They are compiled to DataFrames elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum


class ApiError(Exception):
    """A failure with an HTTP status and a reason that clients can tell apart."""

    def __init__(self, status: int, reason: str, message: str, retry_after: int | None = None) -> None:
        super().__init__(message)
        self.status, self.reason, self.message, self.retry_after = status, reason, message, retry_after


class Op(Enum):
    EQ = "="
    NE = "!="
    RE = "=~"
    NOT_RE = "!~"


@dataclass(frozen=True)
class Matcher:
    field: str
    op: Op
    value: str


@dataclass(frozen=True)
class TextFilter:
    term: str
    regex: bool


@dataclass(frozen=True)
class Window:
    """Half-open, in naive UTC."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class LogPlan:
    matchers: tuple[Matcher, ...]
    text: tuple[TextFilter, ...]
    window: Window
    limit: int
    forward: bool = False


@dataclass(frozen=True)
class MetricPlan:
    name: str
    matchers: tuple[Matcher, ...]
    window: Window
    signal: str
    aggregation: str
    group_by: tuple[str, ...] = ()
    step: int = 60
    limit: int = 5000
    forward: bool = True


@dataclass(frozen=True)
class TracePlan:
    matchers: tuple[Matcher, ...]
    window: Window
    limit: int = 20


@dataclass(frozen=True)
class PromQuery:
    name: str
    signal: str
    aggregation: str
    matchers: tuple[Matcher, ...] = ()
    group_by: tuple[str, ...] = field(default=())
    explicit_grouping: bool = False

"""Log queries: a selector and at most one line filter."""

from __future__ import annotations

from beaconlake.functions import labels
from beaconlake.plans import selectors
from beaconlake.plans.model import LogPlan, TextFilter, Window

REASON = "unsupported_selector"


def parse(text: str, window: Window, limit: int, direction: str = "backward") -> LogPlan:
    """The filter is whichever of |= and |~ comes first; all that follows is its term."""
    at = min((i for i in (text.find("|="), text.find("|~")) if i >= 0), default=None)
    filters: tuple[TextFilter, ...] = ()
    if at is not None:
        regex = text[at + 1] == "~"
        term = selectors.unquote(text[at + 2 :])
        if regex:
            selectors._check_pattern(term, "unsupported_query")
        filters, text = (TextFilter(term, regex),), text[:at]
    _, matchers = selectors.parse(text, REASON)
    return LogPlan(selectors.resolve(matchers, labels.LOGS, REASON), filters, window, limit, direction.lower() == "forward")

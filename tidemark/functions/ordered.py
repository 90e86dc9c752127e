"""A window whose values are kept in order of size as they come and go."""

from __future__ import annotations

import math
from bisect import bisect_left, insort


class OrderedWindow:
    """The last ``days`` values in the order of time and in that of size: a value enters and one leaves, no sorting."""

    def __init__(self, days: int, ring: list | None = None, ordered: list | None = None) -> None:
        self.days, self.ring, self.ordered = days, ring if ring is not None else [], ordered if ordered is not None else []

    def push(self, value: float | None) -> None:
        """A value that is unknown takes a day, but has no size."""
        value = None if value is None or math.isnan(value) else value
        self.ring.append(value)
        if value is not None:
            insort(self.ordered, value)
        if len(self.ring) > self.days:
            gone = self.ring.pop(0)
            if gone is not None:
                del self.ordered[bisect_left(self.ordered, gone)]

    def quantile(self, p: float) -> float | None:
        if not self.ordered:
            return None
        at = p * (len(self.ordered) - 1)
        low = math.floor(at)
        return self.ordered[low] + (at - low) * (self.ordered[math.ceil(at)] - self.ordered[low])

    def interval(self, winsorised: bool) -> tuple[float | None, float | None, float | None]:
        """Lower and upper bound (2.5 and 97.5 percentiles) and mean; values are first drawn in to 1 and 99 if asked for."""
        if not self.ordered:
            return None, None, None
        kept = self
        if winsorised:
            low, high = self.quantile(0.01), self.quantile(0.99)
            kept = OrderedWindow(self.days, self.ring, [min(max(v, low), high) for v in self.ordered])
        return kept.quantile(0.025), kept.quantile(0.975), sum(kept.ordered) / len(kept.ordered)

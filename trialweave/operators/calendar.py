"""The trial calendar and its time slots.

Every time window of a trial (washout, enrolment, drug and measure look-back) is bounded by
dates known before the data is read. Cutting time at all those dates gives *slots*: an
event lies in exactly one slot and every window is a run of whole slots. A window test on
an event then needs only the event's slot, so events can be reduced to one value per
patient and slot before they meet the trials, and no range join is left.
With month starts a slot is a calendar month.
"""

from __future__ import annotations

import calendar as _cal
from bisect import bisect_left
from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialweave.study import CohortSpec

BITS_PER_WORD = 63


def add_months(d: date, n: int) -> date:
    """Month arithmetic that clips to the month's last day, as ``F.add_months`` does."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, _cal.monthrange(y, m + 1)[1]))


def _sql_date(d: date) -> str:
    return f"date'{d.isoformat()}'"


@dataclass(frozen=True)
class Window:
    """A run of slots [lo, hi)."""

    lo: int
    hi: int

    def mask(self, word: int) -> int:
        """Bits of this run inside the given word."""
        first = word * BITS_PER_WORD
        lo, hi = max(self.lo - first, 0), min(self.hi - first, BITS_PER_WORD)
        return (1 << hi) - (1 << lo) if lo < hi else 0


class TrialCalendar:
    """Trial starts with their windows in slot numbers."""

    WINDOWS = ("washout", "arm", "drugs", "measures")

    def __init__(self, spec: CohortSpec):
        self.spec = spec
        self.starts = sorted(spec.starts or [add_months(spec.start, i) for i in range(spec.months)])
        if spec.baseline not in ("enrollment_end", "trial_start"):
            raise ValueError(f"unknown baseline {spec.baseline!r}")

    def bounds(self, start: date) -> dict[str, tuple[date, date]]:
        s, end = self.spec, add_months(start, 1)
        base = end if s.baseline == "enrollment_end" else start
        return {
            "washout": (add_months(start, -s.washout), start),
            "arm": (start, end),
            "drugs": (add_months(base, -s.drug_lookback), base),
            "measures": (add_months(base, -s.measure_lookback), base),
        }

    @cached_property
    def cuts(self) -> list[date]:
        return sorted({d for s in self.starts for pair in self.bounds(s).values() for d in pair})

    @cached_property
    def windows(self) -> list[dict[str, Window]]:
        return [
            {n: Window(bisect_left(self.cuts, a), bisect_left(self.cuts, b)) for n, (a, b) in self.bounds(s).items()}
            for s in self.starts
        ]

    @property
    def words(self) -> int:
        return -(-(len(self.cuts) - 1) // BITS_PER_WORD)

    @cached_property
    def monthly(self) -> bool:
        return all(d.day == 1 for d in self.cuts) and all(
            add_months(a, 1) == b for a, b in zip(self.cuts, self.cuts[1:])
        )

    def covers(self, eventdate: Column) -> Column:
        """Events that can fall into some window; reaches the scan as a date range."""
        return (eventdate >= F.lit(self.cuts[0])) & (eventdate < F.lit(self.cuts[-1]))

    def slot(self, eventdate: Column) -> Column:
        """Slot number of a covered date."""
        if self.monthly:
            first = self.cuts[0]
            return (F.year(eventdate) - first.year) * 12 + F.month(eventdate) - first.month
        return reduce(lambda a, c: a + (eventdate >= F.lit(c)).cast("int"), self.cuts[1:], F.lit(0))

    # The literals below are written as SQL text: one expression to parse instead of
    # hundreds of calls into the JVM.

    def trials(self) -> Column:
        """All trials as one literal array of structs, in order of start."""
        rows = []
        for start, w in zip(self.starts, self.windows):
            fields = {
                "trial_start": _sql_date(start),
                "enrollment_end": _sql_date(add_months(start, 1)),
                "end_followup_date_2y": _sql_date(add_months(start, 24)),
                "end_followup_date_5y": _sql_date(add_months(start, 60)),
                "measures_lo": str(w["measures"].lo),
                "measures_hi": str(w["measures"].hi),
            }
            for n in ("washout", "arm", "drugs"):
                fields |= {f"{n}_mask_{i}": f"{w[n].mask(i)}L" for i in range(self.words)}
            rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
        return F.expr(f"array({', '.join(rows)})")

    def trials_touched(self, window: str, slot: Column) -> Column:
        """Trial starts whose window holds the slot, as an array."""
        by_slot = [
            [s for s, w in zip(self.starts, self.windows) if w[window].lo <= i < w[window].hi]
            for i in range(len(self.cuts) - 1)
        ]
        lists = ", ".join(f"array({', '.join(map(_sql_date, ds))})" for ds in by_slot)
        return F.element_at(F.expr(f"array({lists})"), slot + 1)

    def trials_before(self, slot: Column) -> Column:
        """How many trials have their measure window ended at or before the slot begins."""
        counts = [sum(w["measures"].hi <= i for w in self.windows) for i in range(len(self.cuts))]
        return F.element_at(F.expr(f"array({', '.join(map(str, counts))})"), slot + 1)

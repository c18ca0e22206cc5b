"""A session's window vocabulary, updated batch by batch in order."""

from __future__ import annotations

from . import codecs
from .vocab import MIN_SAVING, WINDOW_CAP


class SessionWindow:
    """The exact ordered update: known patterns add up, new ones enter while there is room; in a full window a new one
    takes the place of the least saving entry that saved less and wasn't seen for more than five batches."""

    def __init__(self, rows: list[tuple[bytes, int, int, int]] | None = None, batches: int = 0, cap: int = WINDOW_CAP):
        self.entries = {bytes(p): [f, s, seen] for p, f, s, seen in rows or []}
        self.batches, self.cap = batches, cap

    def update(self, mined: list[codecs.Entry]) -> bool:
        """Adds one batch; true if the set of patterns changed."""
        changed = False
        self.batches += 1
        for e in mined:
            if e.saving < MIN_SAVING:
                continue
            if e.pattern in self.entries:
                own = self.entries[e.pattern]
                own[0] += e.freq
                own[1] += e.saving
                own[2] = self.batches
            elif len(self.entries) < self.cap:
                self.entries[e.pattern] = [e.freq, e.saving, self.batches]
                changed = True
            else:
                old = [(v[1], p) for p, v in self.entries.items() if v[1] < e.saving and self.batches - v[2] > 5]
                if old:
                    del self.entries[min(old)[1]]
                    self.entries[e.pattern] = [e.freq, e.saving, self.batches]
                    changed = True
        return changed

    def evict(self, age: int = 50, freq: int = 10) -> None:
        """Drops entries that weren't seen for age batches and occurred no more than freq times."""
        self.entries = {p: v for p, v in self.entries.items() if self.batches - v[2] < age or v[0] > freq}

    def rows(self) -> list[tuple[bytes, int, int, int]]:
        return [(p, *v) for p, v in self.entries.items()]

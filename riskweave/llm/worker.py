"""State kept between the tasks of a Python worker."""

from __future__ import annotations

import sys
import types


def process_state(key: str, build):
    """What ``build()`` returned when ``key`` was first asked for.

    A process keeps the state it was asked for last and no other, so its memory
    does not grow with the number of operators that it has worked for.
    """
    store = sys.modules.setdefault("_riskweave_worker_state", types.ModuleType("_riskweave_worker_state")).__dict__
    if key not in store.setdefault("states", {}):
        store["states"].clear()
        store["states"][key] = build()
    return store["states"][key]


class Recent:
    """A table of results that forgets keys not asked for lately.

    It holds at most two generations of about ``max_bytes`` each (more only if
    one text needs more), counted as ENTRY bytes a key and ``weight`` bytes for
    each character or byte of a key, so long keys count as what they are;
    forgetting changes no result. ``now`` is a plain dict, which sets can be
    compared with quickly.
    """

    ENTRY = 200

    def __init__(self, max_bytes: int, weight: int = 5):
        self.max_bytes, self.weight, self.held, self.now, self.before = max_bytes, weight, 0, {}, {}

    def cost(self, keys) -> int:
        return self.ENTRY * len(keys) + self.weight * sum(map(len, keys))

    def missing(self, keys: set) -> list:
        """The keys to compute and put into ``now``; afterwards ``now`` has all ``keys``."""
        new = keys.difference(self.now)
        if new and (self.held + self.cost(new)) > self.max_bytes:
            self.before, self.now, self.held = self.now, {}, 0
            new = keys
        self.held += self.cost(new)
        out, now, before = [], self.now, self.before
        for key in new:
            if key in before:
                now[key] = before[key]
            else:
                out.append(key)
        return out

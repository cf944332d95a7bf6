"""Driver-side result cache: exact key first, then nearest query of the same version and policy."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Sequence


class SemanticCache:
    """At most `capacity` entries, least recently used first out; a new version empties it."""

    def __init__(self, capacity: int = 200, threshold: float = 0.92):
        self.capacity, self.threshold, self.version = capacity, threshold, None
        self.rows: OrderedDict = OrderedDict()

    @staticmethod
    def key(query: str, version, policy, entities: Sequence[str]) -> tuple:
        return query.strip().lower(), version, policy, tuple(sorted(entities))

    def get(self, query: str, embedding: Sequence[float] | None, version, policy, entities: Sequence[str] = ()):
        if version != self.version:
            self.rows.clear()
            self.version = version
        k = self.key(query, version, policy, entities)
        if k not in self.rows and embedding is not None:
            best = max(((_cosine(embedding, e), o) for o, (e, _) in self.rows.items() if e is not None and o[2] == policy), default=(0.0, None), key=lambda x: x[0])
            k = best[1] if best[0] >= self.threshold else k
        if k not in self.rows:
            return None
        self.rows.move_to_end(k)
        return self.rows[k][1]

    def put(self, query: str, embedding, version, policy, entities: Sequence[str], results) -> None:
        if version != self.version:
            self.rows.clear()
            self.version = version
        self.rows[self.key(query, version, policy, entities)] = (embedding, results)
        while len(self.rows) > self.capacity:
            self.rows.popitem(last=False)


def _cosine(a: Sequence[float], b: Sequence[float]) -> float:
    den = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / den if den else 0.0

"""Results kept by content: lookup, policies, memoised calls, and eviction."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.grouping import map_groups

#: Fixed value: bytes an entry costs besides its payload.
ENTRY_COST = 64
READ = {"readWrite": True, "readOnly": True, "refresh": False}
WRITE = {"readWrite": True, "readOnly": False, "refresh": True}


def lookup(requests: DataFrame, cache: DataFrame, keys: list[str], policy: str = "readWrite") -> DataFrame:
    """``requests`` with the cached columns and hit; a policy that does not read misses always."""
    if policy not in READ:
        raise ValueError(f"unknown policy {policy}")
    found = cache.withColumn("hit", F.lit(True)) if READ[policy] else cache.where("false").withColumn("hit", F.lit(True))
    return requests.join(found, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def memoised(requests: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], policy: str = "readWrite") -> tuple[DataFrame, DataFrame]:
    """Results for all requests, and the new entries: ``compute`` sees every key that misses once."""
    told = lookup(requests.select(*keys), cache, keys, policy)
    made = compute(told.where("not hit").select(*keys).distinct())
    known = told.where("hit").drop("hit").distinct().unionByName(made, allowMissingColumns=True)
    return requests.join(known, keys, "left"), made if WRITE[policy] else made.where("false")


def kept_by_recency(entries: DataFrame, budget: int, scope: list[str] | None = None, recency: str = "inserted") -> DataFrame:
    """Entries (payload bytes in n_bytes) that a byte budget keeps if nothing is looked up in between: the newest as far as their running cost
    fits. Entries too large for the budget were never let in."""
    cost = F.col("n_bytes") + ENTRY_COST
    order = Window.partitionBy(*(scope or [])).orderBy(F.desc(recency)) if scope else Window.orderBy(F.desc(recency))
    return entries.where(cost <= budget).withColumn("running", F.sum(cost).over(order)).where(F.col("running") <= budget)


class Lru:
    """An exact cache with promotion on lookup, for batch and streaming alike."""

    def __init__(self, budget: int):
        self.budget, self.used, self.entries = budget, 0, {}

    def apply(self, op: str, key: int, n_bytes: int = 0) -> tuple[bool, list[int]]:
        """insert, lookup, contains, erase or clear: whether it worked or hit, and what was evicted."""
        if op == "clear":
            gone = list(self.entries)
            self.entries, self.used = {}, 0
            return True, gone
        if op == "erase":
            self.used -= self.entries.pop(key, 0)
            return True, []
        if op in ("lookup", "contains"):
            hit = key in self.entries
            if hit and op == "lookup":
                self.entries[key] = self.entries.pop(key)
            return hit, []
        cost = n_bytes + ENTRY_COST
        if cost > self.budget:
            return False, []
        self.used += cost - self.entries.pop(key, 0)
        self.entries[key] = cost
        gone = []
        while self.used > self.budget:
            oldest = next(iter(self.entries))
            self.used -= self.entries.pop(oldest)
            gone.append(oldest)
        return True, gone


def replay(ops: DataFrame, budget: int) -> DataFrame:
    """scope, seq, ok, evicted and used after each operation (scope, seq, op, key, n_bytes) on each scope's cache."""

    def run(rows: list[tuple]) -> Iterable[tuple]:
        cache = Lru(budget)
        for scope, seq, op, key, n in rows:
            ok, gone = cache.apply(op, key, n)
            yield scope, seq, ok, gone, cache.used

    return map_groups(ops.select("scope", "seq", "op", "key", "n_bytes"), ["scope"], ["seq"], run, "scope long, seq long, ok boolean, evicted array<long>, used long", most=1 << 24)

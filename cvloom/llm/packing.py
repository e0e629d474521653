"""Filling containers of fixed capacity with texts (problem 8).

The items differ only in their size, and sizes lie between 0 and the capacity. So the packing is planned on the histogram
of sizes, which is bounded by the capacity whatever the number of texts, and then every text gets the container that the
plan has for its rank among the texts of its size. Nothing else is collected.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cvloom.llm.bpe import TOKENIZERS, token_counts
from cvloom.tables import use_checkpoints

CAPACITY = 1024
#: Steps of the search in all, of some microseconds each: what it has not found by then is not found. `usage` reports
#: how far the result may be from the least number of containers.
STEPS = 5_000_000
#: Steps back after which a search is begun anew with its branches in another order; grows with every attempt.
RETURNS = 250
Pattern = tuple[tuple[int, int], ...]  # (size, how often), largest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on a histogram: (filling, how many containers have it)."""
    open_: dict[int, dict[Pattern, int]] = {}  # room left -> fillings with it
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                per = capacity // size
                new: list[tuple[Pattern, int]] = []
                if left >= per:
                    new.append((((size, per),), left // per))
                if left % per:
                    new.append((((size, left % per),), 1))
                for p, k in new:
                    r = capacity - sum(s * m for s, m in p)
                    open_.setdefault(r, {})
                    open_[r][p] = open_[r].get(p, 0) + k
                left = 0
                continue
            p, k = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            per = room // size
            full = min(k, left // per)
            if not full:
                per, full = left, 1
            q = (*p, (size, per))
            r = room - per * size
            open_.setdefault(r, {})
            open_[r][q] = open_[r].get(q, 0) + full
            left -= per * full
            if k > full:
                open_.setdefault(room, {})
                open_[room][p] = open_[room].get(p, 0) + k - full
    return [(p, k) for group in open_.values() for p, k in group.items()]


class Effort:
    """Steps of the search in all. Counted, not timed, so that the same sizes always give the same plan."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int) -> None:
        self.left -= steps
        if self.left < 0:
            raise Exhausted


class Exhausted(Exception):
    """The steps are used up."""


def _reachable(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each k a bit set of the sums, up to `room`, that items of the sizes from the k-th on can have."""
    mask, out = (1 << room + 1) - 1, [1]
    for s in reversed(sizes):
        bits, n, block = out[-1], min(counts[s], room // s), 1
        while n:
            take = min(block, n)
            bits |= bits << s * take & mask
            n, block = n - take, block * 2
        out.append(bits & mask)
    return out[::-1]


def _filled(total: int, sizes: list[int], counts: dict[int, int], reach: list[int], effort: Effort) -> Iterator[Pattern]:
    """All ways to make `total` of the items, larger items first. Dead ends are known before they are entered."""
    if not total:
        yield ()
        return
    stack: list[tuple[int, int, Pattern]] = [(total, 0, ())]
    while stack:
        left, k, taken = stack.pop()
        effort.spend(1)
        if not left:
            yield taken
            continue
        if not reach[k] >> left & 1:
            continue
        s = sizes[k]
        # the last one pushed is looked at first: as many of the larger size as can be
        stack.append((left, k + 1, taken))
        for m in range(1, min(counts[s], left // s) + 1):
            if reach[k + 1] >> left - m * s & 1:
                stack.append((left - m * s, k + 1, (*taken, (s, m))))


def is_dominated(taken: Pattern, waste: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Could a single item that was left out take the place of some that were taken (or of none), without less filling?

    Whatever the rest of a packing does with such an item, it can do with the smaller ones that it sets free, so a filling
    with such an exchange need not be tried. Exchanges with one item are enough to find every dominated filling.
    """
    sums, single = 1, 0  # bit sets of the sums of any taken items, and of one
    several = 0
    for s, m in taken:
        single |= 1 << s
        for _ in range(m):
            several |= (several | sums & ~1) << s
            sums |= sums << s
    used = dict(taken)
    for x in sizes:
        if counts[x] <= used.get(x, 0):
            continue
        low = max(x - waste, 0)
        window = (1 << x - low + 1) - 1
        if x <= waste or several >> low & window or single >> low & (window >> 1):
            return True
    return False


def fillings(room: int, counts: dict[int, int], sizes: list[int], slack: int, effort: Effort) -> Iterator[tuple[Pattern, int]]:
    """The undominated ways to fill `room` from what is left, wasting at most `slack`, least waste first, one after the
    other as they are asked for: (filling, waste)."""
    effort.spend(100 + len(sizes) // 4)
    reach = _reachable(sizes, counts, room)
    for waste in range(min(slack, room) + 1):
        if reach[0] >> room - waste & 1:
            for p in _filled(room - waste, sizes, counts, reach, effort):
                effort.spend(2 + len(sizes) // 8)
                if not is_dominated(p, waste, sizes, counts):
                    yield p, waste


def _ways(state: dict[int, int], capacity: int) -> np.ndarray:
    """About how many ways there are to fill up a container around an item of each size exactly, with up to three others."""
    c = np.zeros(4 * capacity)  # room for the products, so that they do not wrap around
    for s, n in state.items():
        c[s] = n
    f = np.fft.rfft(c)
    ways = np.fft.irfft(f + f**2 / 2 + f**3 / 6, n=4 * capacity)[: capacity + 1]
    return np.round(ways, 3)[::-1]


def complete_bins(counts: dict[int, int], capacity: int, bins: int, effort: Effort, returns: int, shuffle: random.Random | None = None) -> tuple[list[tuple[Pattern, int]] | None, bool]:
    """Bin completion: a packing into at most `bins` containers or None, and whether the search saw everything.

    At each node the largest item left opens a container, and its undominated fillings are the branches; where no waste is
    left to give, it is the item with the fewest fillings instead. Equal items are interchangeable, so a filling is applied
    as often as the counts allow at once, and fewer times as further branches. A branch is cut when the waste so far exceeds
    what `bins` containers can waste at all. The search gives up after `returns` steps back; `shuffle` changes the order of the
    first branches of a node.
    """
    slack = bins * capacity - sum(s * n for s, n in counts.items())
    if slack < 0:
        return None, True
    state, plan = dict(counts), []

    def branches(spare: int) -> Iterator[tuple[Pattern, int, int]]:
        sizes = sorted((s for s, n in state.items() if n), reverse=True)
        top, ways = sizes[0], None
        if not spare:
            ways = _ways(state, capacity)
            top = min(sizes, key=lambda s: (ways[s], -s))
        state[top] -= 1
        here = dict(state)
        state[top] += 1
        found = fillings(capacity - top, here, [s for s in sizes if here[s]], spare, effort)
        if ways is not None:
            # what is hard to place goes first
            head = sorted(islice(found, 64), key=lambda f: min((float(ways[s]) for s, _ in f[0]), default=0.0) * (shuffle.uniform(0.4, 2.5) if shuffle else 1))
            found = chain(head, found)
        elif shuffle:
            found = chain(sorted(islice(found, 8), key=lambda f: (f[1] + 1) * shuffle.uniform(0.5, 2)), found)
        again = []
        for p, lost in found:
            full = dict(p)
            full[top] = full.get(top, 0) + 1
            q = tuple(sorted(full.items(), reverse=True))
            times = min(state[s] // m for s, m in q)
            if lost:
                times = min(times, spare // lost)
            if times > 0:
                yield q, times, lost
                if times > 1:
                    again.append((q, times, lost))
        for q, times, lost in again:
            for t in range(times - 1, 0, -1):
                yield q, t, lost

    if not any(state.values()):
        return [], True
    # one frame per applied filling: its branches, and the waste left
    stack = [(branches(slack), slack)]
    while stack:
        rest, spare = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            returns -= 1
            if plan:
                q, times = plan.pop()
                for s, m in q:
                    state[s] += m * times
            if returns < 0 and stack:
                return None, False
            continue
        q, times, lost = step
        for s, m in q:
            state[s] -= m * times
        plan.append((q, times))
        if not any(state.values()):
            return plan, False
        stack.append((branches(spare - lost * times), spare - lost * times))
    return None, True


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that the sizes need at least, counting waste that they force.

    Sizes are changed by functions under which whatever fits into a container still fits: those of Martello and Toth (L2;
    a size above capacity - e becomes the capacity, one below e becomes 0) and of Fekete and Schepers (of k + 1 sizes just
    above capacity / (k + 1) only k fit, so each counts 1 / k), one after the other.
    """
    size, n = (np.asarray(x, dtype=np.int64) for x in (list(counts), list(counts.values())))
    k = np.arange(1, 21, dtype=np.int64)[:, None]
    best = -(-int(size @ n) // capacity)
    for e in range(capacity // 2 + 1):
        cut = np.where(size > capacity - e, capacity, np.where(size >= e, size, 0))
        # in units of capacity * k, so that all is exact
        need = np.where((k + 1) * cut % capacity, (k + 1) * cut // capacity * capacity, cut * k) @ n
        best = max(best, -(-int(cut @ n) // capacity), *(-(-int(x) // (capacity * int(j))) for x, j in zip(need, k[:, 0])))
    return best


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[tuple[Pattern, int]], int]:
    """The fillings to use and how often, and a number of containers that no packing can go below.

    Best fit is the incumbent. The numbers of containers from the bound up to the incumbent are searched, the bound first and
    then by bisection; what is completed is the new incumbent. A search that steps back too often is begun again later with
    its branches in another order and more patience, so in the end every one sees everything. All ends when the incumbent
    meets the bound, which a search that saw everything raises, or when the `steps` are used up.
    """
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    bound = lower_bound(counts, capacity)
    plan = best_fit(counts, capacity)
    used, effort, attempt = sum(k for _, k in plan), Effort(steps), 0
    try:
        while bound < used:
            low = bound
            while low < used:
                # the bound itself first, since it ends all; then halfway to the incumbent
                bins = low if low == bound else (low + used - 1) // 2
                better, saw_all = complete_bins(counts, capacity, bins, effort, RETURNS * (1 + attempt // 50), random.Random(attempt) if attempt else None)
                if better is not None:
                    plan, used = better, sum(k for _, k in better)
                else:
                    low = bins + 1
                    if saw_all:
                        bound = max(bound, low)
            attempt += 1
    except Exhausted:
        pass
    return plan, bound


def slots(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size: from which rank on (ascending), the first container of the filling, and items per container."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    container = 1
    for pattern, times in plan:
        for size, m in pattern:
            out.setdefault(size, []).append((given.get(size, 0), container, m))
            given[size] = given.get(size, 0) + m * times
        container += times
    return {s: tuple(np.asarray(x, dtype=np.int64) for x in zip(*rows)) for s, rows in out.items()}


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens): one piece per text, but texts above the capacity are cut into full pieces
    and a rest."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    k = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    return sizes.select("doc_id", n.alias("n"), F.posexplode(F.sequence(F.lit(1), k)).alias("p", "piece_no")).select(
        "doc_id", "piece_no", (F.col("p") * capacity).cast("bigint").alias("first_token"), F.least(F.col("n") - F.col("p") * capacity, F.lit(capacity)).cast("int").alias("tokens")
    )


def pack(items: DataFrame, capacity: int = CAPACITY, per_group: int = 50_000) -> DataFrame:
    """Adds `container_id` (from 1) to items with `tokens` between 0 and `capacity`.

    Ranks within a size are found in two levels, so that a size that a third of all texts share is never in one task: rows
    of a size are spread over buckets of about `per_group` rows, ranked there, and shifted by the counts of the buckets
    before. The histogram and the plan are bounded by the capacity. Items of size 0 go to container 1. Repeated rows are
    items of their own; an empty table gives an empty result.
    """
    spark = items.sparkSession
    use_checkpoints(spark)
    items = items.checkpoint()
    total = items.count()
    buckets = max(1, -(-total // per_group))
    keyed = items.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    by_bucket = keyed.groupBy("tokens", "_b").agg(F.count("*").alias("n"))
    counts = {r.tokens: r.n for r in by_bucket.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    plan, _ = plan_packing(counts, capacity)
    shared = spark.sparkContext.broadcast(slots(plan))
    before = Window.partitionBy("tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("tokens", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("tokens", "_b").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, ["tokens", "_b"]).withColumn("_rank", F.col("_r") + F.col("_before"))

    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.ones(len(tokens), dtype=np.int64)
        t, r = tokens.to_numpy(), rank.to_numpy()
        for size in np.unique(t):
            if size > 0:
                start, first, m = shared.value[int(size)]
                here = t == size
                j = np.searchsorted(start, r[here], side="right") - 1
                out[here] = first[j] + (r[here] - start[j]) // m[j]
        return pd.Series(out)

    return ranked.withColumn("container_id", F.pandas_udf(container, "bigint")("tokens", "_rank")).select(*items.columns, "container_id")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, piece_no, first_token, tokens, container_id) of every text, sized in tokens of byte_bpe_50k."""
    return pack(pieces(token_counts(documents, folder=folder), capacity), capacity)


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens, the number of containers that no packing can go below (counting waste that the sizes
    force), how many more are used, and the share of unused room. The sizes collected are `capacity` at most."""
    counts = {r.tokens: r.n for r in packed.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    filled = packed.where("tokens > 0").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    one = filled.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    one = one.withColumn("least", F.lit(lower_bound(counts, capacity) if counts else 0).cast("bigint"))
    return one.withColumns({"above_least": F.col("containers") - F.col("least"), "unused": F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))})

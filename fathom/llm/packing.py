"""Filling fixed-capacity containers (problem 6) by minimum bin slack.

Only the histogram of item sizes (at most ``capacity`` rows, whatever the data) reaches
the driver.  There each container starts with the largest size left, and a subset-sum
over the remaining multiset, as bitsets, finds the sizes that fill the rest best; the
counts are backtracked through the layers.  A filling repeats as often as its sizes
last, so each step uses up a size: there are at most ``capacity`` fillings, and the plan
has a proven bound.  Items get their place by rank within their size: local ranks of
each partition plus offsets by prefix sums, so that no size, however frequent, is
gathered or sorted in one task.

An item over the capacity, and only such an item, is divided: into full containers and
a rest that is packed like any other.  Items of size 0 (null or empty texts) take no room
and stand in container -1; repeated rows are items of their own, rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import written


def best_filling(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of sizes, at most ``counts`` of each, whose sum comes closest to ``room`` from below."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for size in sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True):
        left, step = min(counts[size], room // size), 1
        while left:
            k = min(step, left)
            layers.append((size, k, reach))
            reach |= reach << (size * k) & mask
            left, step = left - k, step * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for size, k, before in reversed(layers):
        if not before >> goal & 1:
            used[size] = used.get(size, 0) + k
            goal -= size * k
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings (size → number) and how many containers each gives; at most one step per size."""
    left, out = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        filling = best_filling(capacity - top, rest)
        filling[top] = filling.get(top, 0) + 1
        times = min(left[s] // n for s, n in filling.items())
        out.append((filling, times))
        for s, n in filling.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def _slots(fillings: list[tuple[dict[int, int], int]], first: int) -> dict[int, np.ndarray]:
    """Of each size: rows (rank from which on, containers from, number in a container, position of the first)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    for filling, times in fillings:
        at = 0
        for size in sorted(filling, reverse=True):
            n = filling[size]
            slots.setdefault(size, []).append((used.get(size, 0), first, n, at))
            used[size] = used.get(size, 0) + n * times
            at += n
        first += times
    return {s: np.array(v, np.int64) for s, v in slots.items()}


def _local(counter, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, seen, whole = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 0
        for rows in batches:
            out = []
            for i, t in zip(rows["id"], rows["text"]):
                n = counter(t)
                parts = max(1, -(-n // capacity))
                for part in range(parts):
                    size = capacity if part < parts - 1 else n - capacity * (parts - 1)
                    if size == capacity:
                        out.append((i, part, size, pid, whole))
                        whole += 1
                    else:
                        out.append((i, part, size, pid, seen[size]))
                        seen[size] += 1
            yield pd.DataFrame(out, columns=["id", "part", "size", "pid", "local"])

    return run


def _place(slots: dict[int, np.ndarray], capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            container, position = rows["rank"].to_numpy(np.int64, copy=True), np.zeros(len(rows), np.int64)
            size = rows["size"].to_numpy()
            for s in np.unique(size):
                if s in slots:
                    mine = size == s
                    table = slots[s]
                    rank = container[mine]
                    k = np.searchsorted(table[:, 0], rank, "right") - 1
                    off, n = rank - table[k, 0], table[k, 2]
                    container[mine], position[mine] = table[k, 1] + off // n, table[k, 3] + off % n
            container[size == 0] = -1
            yield rows[["id", "part", "size"]].assign(container=container, position=position)

    return run


def pack(df: DataFrame, key: str, text: str, *, capacity: int = 2048, folder: str = tokens.FOLDER, file: str = tokens.FILE) -> DataFrame:
    """(id, part, size, container, position): the place of every document; sizes in tokens of the tokenizer ``file``."""
    source = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    counter = lambda t: tokens.count(t, folder, file)
    items = written(source.mapInPandas(_local(counter, capacity), "id bigint, part int, size int, pid int, local bigint"), "items")
    cells = items.groupBy("size", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("size", "pid", "n", F.coalesce(before, F.lit(0)).alias("offset"))
    counts = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    counts.pop(0, None)
    full = counts.pop(capacity, 0)  # full containers of their own come first
    slots = _slots(plan(counts, capacity), full)
    ranked = items.join(cells.select("size", "pid", "offset"), ["size", "pid"]).select("id", "part", "size", (F.col("offset") + F.col("local")).alias("rank"))
    return ranked.mapInPandas(_place(slots, capacity), "id bigint, part int, size int, container bigint, position bigint")

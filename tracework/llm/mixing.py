"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. Block ``k`` (from 1) of a source of weight
``w`` is released at slot ``(k - 1) / w`` and due by slot ``k / w``, both rounded
outward; of the released blocks the one due earliest gets the slot. At every
slot, each source has had its weight times the slots so far, to within one block.

Weights are exact fractions, as whole numbers of parts without a common divisor,
so the schedule repeats after one period of their sum; of a phase only one period
is laid out, or all its slots where the period is longer. A layout can begin at
any slot: ``state`` finds by arithmetic on releases and deadlines what each source
has had before it. Long layouts are made in tasks, a stretch of slots each. When a
source runs out, the others go on by their weights: a new phase, with the same
bound within it. All documents come out once.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracework.llm.common import map_rows
from tracework.plans.materialize import materialize

#: Documents in a block, sources at most, rows of a numbering bucket.
BLOCK, SOURCES, BUCKET_ROWS = 16, 1_000, 1_000
#: Slots that the driver lays out itself, and slots of a stretch: where tasks lay out, and in memory when a state is found.
DRIVER_SLOTS, STRETCH = 100_000, 50_000


def replay(parts: dict[str, int], had: dict[str, int], slot: int = 0) -> Iterator[str]:
    """The sources of the slots from ``slot`` on, without end, when each source has had ``had`` blocks.

    ``parts`` are positive whole weights. Ties of deadlines go to the source
    whose name comes first.
    """
    total = sum(parts.values())

    def block(s: str, k: int) -> tuple[int, int, str, int]:  # release, deadline, source, block
        return (k - 1) * total // parts[s], -(-k * total // parts[s]), s, k

    waiting = [block(s, had[s] + 1) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            _, due, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, k))
        _, source, k = heapq.heappop(ready)
        yield source
        heapq.heappush(waiting, block(source, k + 1))
        slot += 1


def period(parts: dict[str, int]) -> list[str]:
    """One period of the earliest-deadline-first schedule: the source of each slot; the period is the sum of ``parts``."""
    return list(islice(replay(parts, dict.fromkeys(parts, 0)), sum(parts.values())))


def state(parts: dict[str, int], slot: int) -> dict[str, int]:
    """The blocks that each source has had before ``slot``, without the slots before it.

    A source has had its weight times the slots, rounded down or up. Rounded up
    are those whose pending block is done. Blocks up to a deadline are served as
    if there were no later ones, so in the first t slots they get t less the
    greatest excess of slots over their releases at any time up to t: the slots
    left to later blocks. Only the time since the oldest pending release counts,
    and it is gone through a stretch at a time, so memory does not grow with it.
    """
    total = sum(parts.values())
    whole, slot = divmod(slot, total)
    down = {s: p * slot // total for s, p in parts.items()}
    pending = sorted((-(-(k + 1) * total // parts[s]), s, k * total // parts[s]) for s, k in down.items() if parts[s] * slot % total)
    if pending:
        times = sorted({r for _, _, r in pending})
        ends = [*times[1:], slot]
        least = np.full(len(times), np.iinfo(np.int64).max)
        surplus = sum(-(-p * times[0] // total) for p in parts.values()) - times[0]  # releases less slots
        for start in range(times[0], slot, STRETCH):
            end = min(start + STRETCH, slot)
            released = np.zeros(end - start, np.int64)
            for p in parts.values():
                first, last = -(-p * start // total), -(-p * end // total)
                np.add.at(released, [k * total // p - start for k in range(first, last)], 1)
            after = surplus + np.cumsum(released - 1)
            surplus = int(after[-1])
            for i in range(bisect_right(times, start) - 1, bisect_left(times, end)):
                least[i] = min(least[i], after[max(times[i] - start, 0) : ends[i] - start].min())
        at = [times.index(r) for _, _, r in pending]
        later = np.cumsum(np.bincount(at, minlength=len(times)))
        base, before = sum(down.values()), 0
        for (_, s, _), k in zip(pending, at):
            later[k:] -= 1
            done = slot - max(0, int((later - least).max())) - base
            down[s] += done - before
            before = done
    return {s: whole * parts[s] + k for s, k in down.items()}


def whole_parts(weights: dict) -> dict[str, int]:
    """Weights (numbers, exact as they are written) as whole parts of the same proportions."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    return _reduced({s: int(w * whole) for s, w in exact.items()})


def _reduced(parts: dict[str, int]) -> dict[str, int]:
    common = math.gcd(*parts.values())
    return {s: p // common for s, p in parts.items()}


def phases(parts: dict[str, int], blocks: dict[str, int]) -> list[tuple[int, dict[str, int], dict[str, int], int]]:
    """Phases ``(first slot, parts of the live sources, blocks each had before, slots)``."""
    left = {s: n for s, n in blocks.items() if n > 0}
    had = dict.fromkeys(left, 0)
    out, slot = [], 0
    while left:
        live = _reduced({s: parts[s] for s in left})
        total = sum(live.values())
        # No last block is released before this slot; from here, slot by slot to the first one.
        length = min((n - 1) * total // live[s] for s, n in left.items())
        took = state(live, length)
        for s in replay(live, dict(took), length):
            took[s] += 1
            length += 1
            if took[s] == left[s]:
                break
        out.append((slot, live, dict(had), length))
        for s, n in took.items():
            had[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += length
    return out


def _laid(parts: dict[str, int], first: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Source, number of the block in it, and slot, of the slots from ``first`` to before ``end`` of a phase."""
    got = state(parts, first)
    for at, s in zip(range(first, end), replay(parts, dict(got), first)):
        yield s, got[s], at
        got[s] += 1


def _layout(spark, found: list[tuple]) -> tuple[DataFrame, int]:
    """``_s, phase, place, at`` of one period of each phase, or of the whole phase where that is shorter, and the number of rows."""
    slots = [min(length, sum(live.values())) for _, live, _, length in found]
    schema = "_s string, phase int, place long, at long"
    if sum(slots) <= DRIVER_SLOTS:
        rows = [(s, p, place, at) for p, n in enumerate(slots) for s, place, at in _laid(found[p][1], 0, n)]
        return spark.createDataFrame(rows, schema), len(rows)
    shared = spark.sparkContext.broadcast([live for _, live, _, _ in found])
    # A stretch looks back by one window of the lightest source at most; it is as long, so the work stays in proportion.
    stretches = []
    for p, n in enumerate(slots):
        live = found[p][1]
        step = max(STRETCH, min(n, sum(live.values()) // min(live.values())))
        stretches += [(p, k, min(k + step, n)) for k in range(0, n, step)]

    def make():
        def run(r: dict) -> list:
            out = [
                (s, p, place, at)
                for p, first, end in zip(r["p"], r["first"], r["end"])
                for s, place, at in _laid(shared.value[p], first, end)
            ]
            return [list(c) for c in zip(*out)]

        return run

    each = spark.createDataFrame(stretches, "p int, first long, end long").repartition(len(stretches))
    return materialize(map_rows(each, schema, make)), sum(slots)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    seed: int = 1,
) -> DataFrame:
    """Place every row of ``docs`` in the mixed order.

    Returns all columns and ``mix_block`` (number of the block in its source,
    from 0), ``mix_slot`` (its slot in the schedule, from 0) and ``mix_place``
    (place of the row in its block). ``weights`` gives relative weights;
    sources without one, or with none at all, weigh 1; zero and below is an
    error. A null source is a source of its own, named as the empty text.
    Within a source, rows go by a hash of the whole row, so repeated rows and null
    ids have places too. An empty table gives an empty result; columns of the added names are replaced, others keep
    their values, whatever their names.
    """
    added = ("mix_block", "mix_slot", "mix_place")
    docs = docs.drop(*added)
    if weights is not None and any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    # The rows travel as one column, so no name of theirs meets one of this plan.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s"),
    )
    # Of the whole row: rows that share an id, or have none, are dealt over the buckets like others.
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_row"))
    spark = docs.sparkSession
    per_source = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).orderBy("_s").limit(SOURCES + 1).collect()
    if len(per_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = {r["_s"]: r["n"] for r in per_source}
    # A source has as many buckets as it has need of, so they are alike in size. They are ranges of the hash, so
    # that their order is the order of the rows.
    buckets = {s: -(-n // BUCKET_ROWS) for s, n in sizes.items()}
    dealt = spark.createDataFrame(list(buckets.items()), "_s string, _nb int")  # a row for each source
    rows = rows.join(F.broadcast(dealt), "_s").withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * F.col("_nb")).cast("int"))
    counts = materialize(rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n")))
    parts = whole_parts({s: (weights or {}).get(s, 1) for s in sizes}) if sizes else {}
    blocks = {s: -(-n // BLOCK) for s, n in sizes.items()}

    found = phases(parts, blocks)
    plan, slots = _layout(spark, found)
    mine: dict[str, list[tuple]] = {s: [] for s in sizes}
    for phase, (first, live, had, length) in enumerate(found):
        again = sum(live.values()) < length  # else a block's place is its number in the phase
        for s in live:
            mine[s].append((phase, had[s], live[s] if again else 1 << 62, first, sum(live.values()) if again else 0))
    starts = spark.createDataFrame(
        list(mine.items()), "_s string, phases array<struct<phase:int,had:long,per:long,first:long,period:long>>"
    )
    offset = counts.withColumn(
        "before", F.sum("n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    ).select("_s", "_b", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = (
        rows.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", F.xxhash64(F.lit(~seed), "_row"))))
        .join(F.broadcast(offset) if sum(buckets.values()) < 200_000 else offset, ["_s", "_b"])
        .withColumn("_n", F.col("before") + F.col("_r") - 1)
        .withColumns({"mix_block": F.expr(f"_n div {BLOCK}"), "mix_place": F.pmod("_n", F.lit(BLOCK)).cast("int")})
        .join(F.broadcast(starts), "_s")
        .withColumn("_p", F.element_at(F.filter("phases", lambda x: x["had"] <= F.col("mix_block")), -1))
        .withColumns(
            {"phase": F.col("_p.phase"), "_k": F.col("mix_block") - F.col("_p.had")}
        )
        .withColumn("place", F.col("_k") % F.col("_p.per"))
    )
    placed = numbered.join(F.broadcast(plan) if slots <= DRIVER_SLOTS else plan, ["_s", "phase", "place"]).withColumn(
        "mix_slot", F.col("_p.first") + F.expr("_k div _p.per") * F.col("_p.period") + F.col("at")
    )
    return placed.select("_row.*", *added)


def lag(parts: dict, order: list[str]) -> Fraction:
    """The greatest deviation, in blocks, of a schedule from its weights (whole numbers or fractions)."""
    total, got, worst = sum(parts.values()), dict.fromkeys(parts, 0), Fraction(0)
    for slot, s in enumerate(order, 1):
        got[s] += 1
        worst = max(worst, *(abs(got[x] - Fraction(parts[x] * slot, total)) for x in parts))
    return worst

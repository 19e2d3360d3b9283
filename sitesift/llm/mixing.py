"""Mixing sources to target weights by Pfair scheduling.

Each source (lane) is a task that emits blocks of documents. Weights are exact fractions:
as whole shares a of their sum A, block j of a lane has release time floor(j*A/a) and
deadline ceil((j+1)*A/a); one block leaves per slot, earliest deadline first among
released ones, so at any slot each lane is less than one block away from its target. The
schedule repeats after A slots, so one period of it places any number of blocks. When a
lane runs out, the rest go on with their weights scaled up: a new phase, in which the same
bound holds from its first slot on.

A phase is planned slot by slot for one period or for the blocks that are left, whichever
is shorter. Only where both exceed LONGEST are its weights rounded, to multiples of
1/LONGEST: then a lane drifts from its target by at most one block in LONGEST slots.

Documents are numbered inside their lane in an order shuffled by a hash of the id and the
row: hash buckets of bounded size, numbered within and offset by bucket sums in two steps,
so a lane with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.llm.common import free_name, stored

LONGEST = 1 << 18    # slots of a phase that are planned and broadcast at most
BUCKET = 1024        # rows of a hash bucket, about
REST = "*"           # lane of sources without a weight of their own


def shares(weights: dict[str, float], longest: int | None = None) -> dict[str, int]:
    """Whole shares without a common divisor, as the weights (read as decimals) have them;
    with ``longest``, that many in all, each at least one, by largest remainder."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * unit) for k, w in exact.items()}
    divisor = math.gcd(*whole.values())
    whole = {k: w // divisor for k, w in whole.items()}
    total = sum(whole.values())
    if longest is None or total <= longest:
        return whole
    if len(whole) > longest:
        raise ValueError(f"{len(whole)} lanes need as many slots, not {longest}")
    got = {k: max(1, w * longest // total) for k, w in whole.items()}
    order = sorted(whole, key=lambda k: (-(whole[k] * longest % total), k))
    for k in order[:max(0, longest - sum(got.values()))]:
        got[k] += 1
    while sum(got.values()) > longest:
        got[max(got, key=lambda k: (got[k], k))] -= 1
    return got


def period(share: dict[str, int], slots: int | None = None) -> dict[str, list[int]]:
    """Slots of each lane's blocks, earliest deadline first, for one period or its first
    ``slots``."""
    size = sum(share.values())
    release = [(0, k, 0) for k in share]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {k: [] for k in share}
    for t in range(size if slots is None else min(slots, size)):
        while release and release[0][0] <= t:
            _, k, j = heapq.heappop(release)
            heapq.heappush(ready, (-(-(j + 1) * size // share[k]), k, j))
        deadline, k, j = heapq.heappop(ready)
        assert t < deadline
        out[k].append(t)
        heapq.heappush(release, ((j + 1) * size // share[k], k, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], longest: int = LONGEST) -> list[dict]:
    """Phases until every lane is empty: first slot, period, and by lane its share, the blocks
    it had emitted before, and its slots of a period. At most one phase per lane."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done, base, out = {k: 0 for k in left}, 0, []
    while left:
        rest = sum(left.values())
        share = shares({k: weights[k] for k in left}, None if rest <= longest else longest)
        grid = sum(share.values())
        slots = period(share, rest)
        # a lane whose blocks don't all lie in a plan cut short does not end first
        last = {k: (n - 1) // share[k] * grid + slots[k][(n - 1) % share[k]] for k, n in left.items()
                if (n - 1) % share[k] < len(slots[k])}
        size = min(last.values()) + 1
        out.append({"base": base, "grid": grid, "lanes": {k: (share[k], done[k], slots[k]) for k in left}})
        for k in list(left):
            n = size // grid * share[k] + bisect.bisect_left(slots[k], size % grid)
            done[k] += n
            left[k] -= n
            if left[k] <= 0:
                del left[k]
        base += size
    return out


def lane_of(source: str, weights: dict[str, float]) -> Column:
    named = F.col(source).cast("string")
    return F.when(named.isin(*[k for k in weights if k != REST]), named).otherwise(F.lit(REST))


def numbered(rows: DataFrame, lane: str, key: Column, out: str, total: int) -> DataFrame:
    """``rows`` with a dense number from 0 within each lane, in hash order of ``key``.

    Rows with equal keys are numbered in any order among themselves; the numbers are
    written once, so a repeated task cannot change them."""
    n = max(1, math.ceil(total / BUCKET))
    group = max(1, math.isqrt(n))
    h, b, g, i, c, o = (free_name(rows, x) for x in ("_h", "_b", "_g", "_i", "_c", "_o"))
    # buckets are ranges of the hash, so the order is the hash's own
    rows = rows.withColumn(h, F.xxhash64(key)).withColumn(
        b, F.floor((F.col(h).cast("double") + 2.0 ** 63) / 2.0 ** 64 * n).cast("long"))
    rows = rows.withColumn(b, F.least(F.col(b), F.lit(n - 1).cast("long")))
    inside = rows.withColumn(i, F.row_number().over(Window.partitionBy(lane, b).orderBy(h, key)) - 1)
    inside = stored(inside, "mix-numbered")
    sums = inside.groupBy(lane, b).agg(F.count(F.lit(1)).alias(c)).withColumn(
        g, F.floor(F.col(b) / group).cast("long"))
    upto = sums.withColumn(o, F.coalesce(F.sum(c).over(
        Window.partitionBy(lane, g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = sums.groupBy(lane, g).agg(F.sum(c).alias(c)).select(lane, g, F.coalesce(F.sum(c).over(
        Window.partitionBy(lane).orderBy(g).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(c))
    offset = upto.drop(c).join(ahead, [lane, g]).select(lane, b, (F.col(o) + F.col(c)).alias(o))
    return (inside.join(offset, [lane, b]).withColumn(out, (F.col(i) + F.col(o)).cast("long"))
            .drop(h, b, i, o))


def mix(docs: DataFrame, weights: dict[str, float], block: int = 64, id_col: str = "doc_id",
        source_col: str = "source", longest: int = LONGEST) -> DataFrame:
    """All rows and columns of ``docs`` with mix_lane, mix_block (number of the block in
    its lane), mix_release, mix_deadline, mix_slot and mix_position (slot * block + place
    in the block; ordering by it gives the mixture).

    ``weights`` names lanes; sources it doesn't name, null ones too, share the lane "*"
    (the least given weight unless it is given). No row is dropped or repeated, equal
    rows included; a lane's last block may be short; an empty table gives no rows. Names
    taken by columns of ``docs`` get a trailing underscore.
    """
    weights = {str(k): float(w) for k, w in weights.items()}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    weights.setdefault(REST, min(weights.values(), default=1.0))
    lane, rank = free_name(docs, "mix_lane"), free_name(docs, "_rank")
    rows = docs.withColumn(lane, lane_of(source_col, weights))
    # one row per lane, at most as many as weights were given
    counts = {r[0]: r[1] for r in rows.groupBy(lane).agg(F.count(F.lit(1))).collect()}
    plan = phases({k: -(-n // block) for k, n in counts.items()}, weights, longest)
    # rows with equal or null ids are told apart by what else they hold
    simple = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(*simple).cast("string"))
    ranked = numbered(rows, lane, key, rank, sum(counts.values()))
    spark = docs.sparkSession
    names = {n: free_name(docs, n) for n in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")}
    table = []
    for k in counts:
        steps = [(p["base"], p["grid"], *p["lanes"][k]) for p in plan if k in p["lanes"]]
        table.append((k, [{"base": b, "grid": g, "share": a, "done": d, "slots": s} for b, g, a, d, s in steps]))
    p = free_name(docs, "_phases")
    schema = (f"`{lane}` string, `{p}` array<struct<base:bigint,grid:bigint,share:bigint,done:bigint,slots:array<int>>>")
    # at most LONGEST slots for each of at most len(weights) phases
    lookup = F.broadcast(spark.createDataFrame(table, schema))
    blk, ph, j = names["mix_block"], free_name(docs, "_ph"), free_name(docs, "_j")
    out = (ranked.join(lookup, lane).withColumn(blk, F.floor(F.col(rank) / block).cast("long"))
           .withColumn(ph, F.expr(f"element_at(filter(`{p}`, x -> x.done <= `{blk}`), -1)"))
           .withColumn(j, F.col(blk) - F.col(ph)["done"]))
    out = (out.withColumn(names["mix_release"], F.expr(f"`{ph}`.base + `{j}` * `{ph}`.grid div `{ph}`.share"))
           .withColumn(names["mix_deadline"], F.expr(
               f"`{ph}`.base + ((`{j}` + 1) * `{ph}`.grid + `{ph}`.share - 1) div `{ph}`.share"))
           .withColumn(names["mix_slot"], F.expr(f"`{ph}`.base + `{j}` div `{ph}`.share * `{ph}`.grid"
                                                 f" + element_at(`{ph}`.slots, int(`{j}` % `{ph}`.share) + 1)"))
           .withColumn(names["mix_position"], F.col(names["mix_slot"]) * block + F.col(rank) % block))
    return out.select(*docs.columns, lane, *names.values())

"""Mixing sources to target weights, by min-cost flow over membership patterns."""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.operators.prefix import running_total
from reelspan.session import cut_lineage, small_rows


def min_cost_flow(sizes: list[int], member: list[list[int]], quotas: list[Fraction], repeats: list[int]) -> dict[tuple[int, int], Fraction]:
    """Flow from pattern i to source j, as near to ``quotas`` as the capacities allow and, of those, with least repetition.

    Pattern i has one unit of capacity ``sizes[i]`` for each lap; lap k costs k per token (convex: the second copy of
    one document is dearer than the first of another). A pattern may go to the sources in ``member[i]``, to source j
    at most ``repeats[j]`` laps of it. All costs lie on the edges out of the origin, so the sets of them that a flow can use are a
    matroid, and the cheapest flow is found lap by lap: each lap's capacity is added and the flow augmented by levelled shortest
    paths, which leaves what cheaper laps carry. Exact: amounts are whole numbers, of the common denominator of the quotas.
    """
    unit = math.lcm(1, *[q.denominator for q in quotas])
    room = [[size * repeats[j] * unit for j in js] for size, js in zip(sizes, member)]
    flow = [[0] * len(js) for js in member]
    into: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for i, js in enumerate(member):
        for x, j in enumerate(js):
            into[j].append((i, x))
    left = [int(q * unit) for q in quotas]
    supply = [0] * len(sizes)
    laps = [sum(repeats[j] for j in js) for js in member]
    for lap in range(max(laps, default=0)):
        if not any(left):
            break
        for i, size in enumerate(sizes):
            if lap < laps[i]:
                supply[i] += size * unit
        while _augment(supply, left, room, flow, member, into):
            pass
        supply = [0] * len(sizes)  # what this lap could not send, a dearer one of the same pattern cannot either
    return {(i, j): Fraction(f, unit) for i, js in enumerate(member) for j, f in zip(js, flow[i]) if f}


def _augment(supply: list[int], left: list[int], room: list[list[int]], flow: list[list[int]], member: list[list[int]], into: list[list[tuple[int, int]]]) -> bool:
    """One phase of levelled augmentation from patterns with ``supply`` to sources with something ``left``; whether anything was sent."""
    n = len(supply)
    level: dict[int, int] = {i: 0 for i in range(n) if supply[i]}  # sources are numbered from n on
    queue, found = deque(level), False
    while queue:
        x = queue.popleft()
        if x < n:
            near = [n + j for y, j in enumerate(member[x]) if flow[x][y] < room[x][y]]
        else:
            found = found or left[x - n] > 0
            near = [i for i, y in into[x - n] if flow[i][y] > 0] if not found else []
        for z in near:
            if z not in level:
                level[z] = level[x] + 1
                queue.append(z)
    if not found:
        return False
    at = dict.fromkeys(level, 0)  # the next edge to try
    sent = False
    for start in [i for i in level if i < n and supply[i]]:
        while supply[start]:
            path: list[tuple[int, int, int]] = []  # (pattern, its edge, direction)
            x = start
            while x < n or not left[x - n]:
                edges = member[x] if x < n else into[x - n]
                while at[x] < len(edges):
                    if x < n:
                        z, step = n + edges[at[x]], (x, at[x], 1)
                        fits = flow[x][at[x]] < room[x][at[x]]
                    else:
                        z, step = edges[at[x]][0], (*edges[at[x]], -1)
                        fits = flow[step[0]][step[1]] > 0
                    if fits and level.get(z, -1) == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(edges):
                    path.append(step)
                    x = z
                elif path:  # a dead end: back, past the edge that led here
                    i, y, way = path.pop()
                    x = i if way > 0 else n + member[i][y]
                    at[x] += 1
                else:
                    break
            if not path:
                break
            amount = min(supply[start], left[x - n], *[room[i][y] - flow[i][y] if way > 0 else flow[i][y] for i, y, way in path])
            for i, y, way in path:
                flow[i][y] += way * amount
            supply[start] -= amount
            left[x - n] -= amount
            sent = True
    return sent


def _plan(patterns: list, targets: list) -> list[tuple]:
    """Rows (mix_id, source, pattern or None, flow from, flow length, quota, reachable) of every mix."""
    total = sum(size for _, size in patterns)
    mixes: dict[str, dict[str | None, tuple]] = {}
    for t in targets:
        name = None if t.source is None else t.source.strip().lower()
        row = (t.target_share or 0.0, int(t.max_repeats or 0), t.size_factor or 0.0, t.source or "", t.source)
        mixes.setdefault(t.mix_id, {})[name] = max(row, mixes.get(t.mix_id, {}).get(name, row))
    out = []
    for mix, rows in mixes.items():
        want, names = list(rows.values()), {k: j for j, k in enumerate(rows) if k is not None}
        member = [sorted({names[s] for s in p if s in names}) for p, _ in patterns]
        use = [i for i, m in enumerate(member) if m and patterns[i][1] > 0]
        quota = [Fraction(w[0]) * Fraction(w[2]) * total for w in want]
        flow = min_cost_flow([patterns[i][1] for i in use], [member[i] for i in use], quota, [w[1] for w in want])
        start = {i: Fraction(0) for i in range(len(use))}
        got = [Fraction(0)] * len(want)
        for (i, j), f in sorted(flow.items()):
            out.append((mix, want[j][4], list(patterns[use[i]][0]), float(start[i]), float(f), float(quota[j]), False))
            start[i] += f
            got[j] += f
        out += [(mix, w[4], None, 0.0, float(got[j]), float(quota[j]), got[j] < quota[j]) for j, w in enumerate(want)]
    return out


def _pattern(names: list[str]) -> Column:
    """The sources of a document that any target names, in order."""
    return F.sort_array(F.array_intersect(F.coalesce("sources", F.array().cast("array<string>")), F.array(*map(F.lit, names)).cast("array<string>")))


PLAN = "mix_id string, source string, pattern array<string>, flow_from double, flow_size double, quota double, out_of_reach boolean"


def plan_mixes(documents: DataFrame, targets: DataFrame, most_patterns: int = 200_000, most_targets: int = 10_000) -> DataFrame:
    """The flows of every mix (``pattern`` set) and its sources' totals (``pattern`` null): columns of ``PLAN``.

    ``documents``: ``doc_id, size, sources`` (array of the sources a document belongs to, trimmed, in lower case; empty:
    none); ``targets``: ``mix_id, source, target_share, max_repeats, size_factor``. Only the sizes by membership pattern come to the
    driver; sources that no target names are left out of the patterns, so there are few; more than ``most_patterns`` raise, as
    does ``most_targets``. A mix is to have ``size_factor`` times the size of all documents.
    ``out_of_reach``: the source's quota is more than all its documents repeated as often as allowed.
    Null shares, repeats and factors count as 0; a null source has no documents. Of repeated rows of a mix and source, in any spelling,
    the one of the largest share holds, of those that of the most repeats, then of the largest factor.
    """
    spark = documents.sparkSession
    rows = small_rows(targets.select("mix_id", "source", "target_share", "max_repeats", "size_factor"), most_targets, "targets")
    names = sorted({r.source.strip().lower() for r in rows if r.source is not None})
    by = documents.groupBy(_pattern(names).alias("p")).agg(F.sum("size").cast("bigint").alias("s"))
    patterns = sorted((tuple(r.p), int(r.s or 0)) for r in small_rows(by, most_patterns, "membership patterns"))
    return spark.createDataFrame(_plan(patterns, rows), PLAN)


def select_documents(documents: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``mix_id, source, doc_id, size, repeats``: the documents that carry the flows of ``plan``.

    The documents of a pattern lie one behind the other in an order by a seeded hash; a flow is a stretch of this tape,
    run through again at each lap, and has a document once for each time that the document's middle lies in it. So a
    source is off its flow by at most one document at either end, and no document is repeated more often than there are
    laps. The positions are running totals by ranges of the hash, so no pattern is held by one task.
    """
    names = sorted({r.source.strip().lower() for r in plan.where("pattern IS NULL AND source IS NOT NULL").select("source").distinct().collect()})  # as many as targets
    docs = documents.select("doc_id", F.col("size").cast("bigint").alias("size"), _pattern(names).alias("pattern"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    # sizes without texts, read several times below
    tape = running_total(cut_lineage(docs.where(F.size("pattern") > 0)), ["pattern"], "h", "size", ties=["doc_id"])
    flows = plan.where("pattern IS NOT NULL").select("mix_id", "source", F.col("pattern").alias("p"), "flow_from", "flow_size")
    mid = F.col("total_before") + F.col("size") / 2
    end = F.col("flow_from") + F.col("flow_size")
    # laps whose copy of the middle is at or after x: none before the first
    laps = lambda x: F.greatest(F.lit(0), F.ceil(F.try_divide(x - mid, F.col("group_total"))))
    return (
        tape.join(F.broadcast(flows), F.col("pattern") == F.col("p")).where("group_total > 0")
        .withColumn("repeats", (laps(end) - laps(F.col("flow_from"))).cast("int"))
        .where("repeats > 0").select("mix_id", "source", "doc_id", "size", "repeats")
    )


def reached(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Per (mix, source): quota, flow, what was selected and its share of the mix's selected size."""
    got = selected.groupBy("mix_id", "source").agg(F.sum(F.col("size") * F.col("repeats")).alias("got"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_docs"))
    want = plan.where("pattern IS NULL").select("mix_id", "source", "quota", "flow_size", "out_of_reach")
    all_ = want.join(got, ["mix_id", "source"], "left").fillna(0, ["got", "most_repeats", "n_docs"])
    sums = all_.groupBy("mix_id").agg(F.sum("got").alias("_sum"))
    return all_.join(sums, "mix_id").withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("got"), F.col("_sum")), F.lit(0.0)), 6)).drop("_sum")

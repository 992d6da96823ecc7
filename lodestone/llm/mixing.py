"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are gathered by membership pattern (the set of sources they belong to). Word capacity flows from patterns to
source quotas; a pattern's second and third repetition cost more than its first (convex costs), so nothing is repeated
while unread text of a fitting source is left. The flow runs on the driver over one row per pattern, never per document.

A pattern's flow is laid out along its documents in seeded order, repetition after repetition, and cut where one
source's share ends. The documents of each size class are cut by themselves, from the longest down, and what a class takes
too much or too little is carried to the next: in the end a cut is off by half a short document. Only the cuts are searched
for: in a histogram of 4,096 hash ranges per pattern, then among the documents of the ranges that hold a cut. Whether a
document is taken follows from its hash and size alone, so texts are never shuffled, a hot source is spread over all
tasks, and reruns agree.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.columns import unused
from lodestone.plans.scratch import Scratch

WEIGHTS = (5, 2, 1)          # repeated over the sources by code point, null last
MAX_COPIES = 3
COPY_COSTS = (0, 1, 3)       # cost of a word's first, second and third use
SEED = 20240229
MAX_PATTERNS = 20_000        # the driver holds a row per pattern; more are refused, not cut
CLASSES = (2048, 256, 32)    # words: longer documents than these are cut first
_RANGES = 12                 # bits of the histogram
_ALL = (1 << 63) - 1         # above every seeded key


@dataclass(frozen=True)
class Plan:
    """``sources``: name, size and target of each; ``flows``: words that each pattern gives to each of its sources."""

    sources: list[tuple[str | None, int, Fraction]]
    flows: dict[str, dict[str | None, int]]
    sizes: dict[str, int]


def quotas(sizes: list[int], weights: list[int], total: int, most: int = MAX_COPIES) -> list[Fraction]:
    """Targets by weight that stop at ``most`` times a size; the excess is shared again until none is above."""
    targets, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > weight * most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            return targets
        for i in full:
            targets[i] = Fraction(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def min_cost_flow(patterns: dict[str, tuple[int, list]], quota: dict, costs=COPY_COSTS) -> dict[str, dict]:
    """Words from each pattern (capacity, sources) to each source: as many as fit, at the least cost of repetition."""
    start, end = ("start",), ("end",)
    arcs: dict[tuple, dict[tuple, list]] = defaultdict(dict)  # node -> node -> [capacity, cost]

    def arc(a, b, capacity, cost):
        arcs[a][b] = [capacity, cost]
        arcs[b].setdefault(a, [0, -cost])

    for name, (capacity, members) in patterns.items():
        for level, cost in enumerate(costs):
            arc(start, ("level", name, level), capacity, cost)
            arc(("level", name, level), ("pattern", name), capacity, 0)
        for source in members:
            arc(("pattern", name), ("source", source), capacity * len(costs), 0)
    for source, words in quota.items():
        arc(("source", source), end, words, 0)
    while True:
        dist, came, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b, (capacity, cost) in arcs[a].items():
                if capacity > 0 and dist[a] + cost < dist.get(b, float("inf")):
                    dist[b], came[b] = dist[a] + cost, a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if end not in dist:
            break
        path, at = [], end
        while at != start:
            path.append((came[at], at))
            at = came[at]
        pushed = min(arcs[a][b][0] for a, b in path)
        for a, b in path:
            arcs[a][b][0] -= pushed
            arcs[b][a][0] += pushed
    return {name: {s: arcs[("source", s)][("pattern", name)][0] for s in members}
            for name, (_, members) in patterns.items()}


def _order(source: str | None) -> tuple:
    return (source is None, source or "")


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share: Fraction = Fraction(1), most: int = MAX_COPIES) -> Plan:
    """The flow for a table ``pattern, members, size`` of one row per pattern."""
    rows = sizes.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    held: dict = defaultdict(int)
    for row in rows:
        for source in row["members"]:
            held[source] += row["size"]
    names = sorted(held, key=_order)
    weight = [weights[i % len(weights)] for i in range(len(names))]
    total = sum(row["size"] for row in rows)
    target = quotas([held[s] for s in names], weight, share * total, most)
    patterns = {row["pattern"]: (row["size"], sorted(row["members"], key=_order)) for row in rows}
    flows = min_cost_flow(patterns, {s: round(t) for s, t in zip(names, target, strict=True)}, COPY_COSTS[:most])
    return Plan([(s, held[s], t) for s, t in zip(names, target, strict=True)], flows, {p: c for p, (c, _) in patterns.items()})


def _cuts(plan: Plan) -> list[tuple]:
    """``pattern, source, whole, rest``: where each source's share ends, in whole repetitions and words of the next."""
    out = []
    for pattern, flow in plan.flows.items():
        at = 0
        for source in sorted(flow, key=_order):
            at += flow[source]
            out.append((pattern, source, *(divmod(at, plan.sizes[pattern]) if plan.sizes[pattern] else (0, 0))))
    return out


def _cut_keys(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """For every cut inside a repetition: the last hash whose documents lie, by their middle, before the cut, and the words
    up to it."""
    shift = 63 - _RANGES
    ranged = marked.withColumn("range", F.shiftright("key", shift))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("range")) - F.col("words")
    ranges = (ranged.groupBy("pattern", "range").agg(F.sum("size").alias("words")).withColumn("before", before)
              .join(F.broadcast(cuts), "pattern")
              .filter((F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))))
    near = ranged.join(F.broadcast(ranges.select("pattern", "range").distinct()), ["pattern", "range"])
    keys = near.groupBy("pattern", "range", "key").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern", "range").orderBy("key")
    middle = keys.withColumn("upto", F.sum("words").over(run)).withColumn("middle", F.col("upto") - F.col("words") / 2)
    inside = middle.join(F.broadcast(ranges.select("pattern", "range", "before", "rest").distinct()), ["pattern", "range"])
    found = inside.groupBy("pattern", "rest", "range", "before").agg(
        F.max(F.when(F.col("before") + F.col("middle") < F.col("rest"), F.struct("key", "upto"))).alias("last"))
    # where no document of the range lies before the cut, all earlier ranges do
    return found.select("pattern", "rest", F.coalesce(
        "last.key", F.call_function("shiftleft", F.col("range").cast("long"), F.lit(shift)) - 1).alias("last"),
        (F.col("before") + F.coalesce("last.upto", F.lit(0))).alias("taken"))


def _settled(marked: DataFrame, plan: Plan) -> dict[tuple, list]:
    """``source, whole, last`` of every cut, in order, by pattern and size class: rows up to the key ``last`` lie before it."""
    spark = marked.sparkSession
    words = {(r["pattern"], r["class"]): r["words"] for r in marked.groupBy("pattern", "class").agg(
        F.sum("size").alias("words")).collect()}  # a row per pattern and class
    by_pattern = defaultdict(list)
    for pattern, source, whole, rest in _cuts(plan):
        by_pattern[pattern].append((source, whole, rest))
    carried: dict = defaultdict(Fraction)
    out: dict = defaultdict(list)
    for size_class in range(len(CLASSES) + 1):
        goals = {}
        for pattern, cuts in by_pattern.items():
            held, least = words.get((pattern, size_class), 0), {}
            for i, (_, whole, rest) in enumerate(cuts):
                own = Fraction(rest * held, plan.sizes[pattern]) if plan.sizes[pattern] else Fraction(0)
                goal = min(max(own + carried[pattern, i], least.get(whole, 0)), held)  # later cuts never lie before earlier ones
                least[whole], goals[pattern, i] = goal, (own + carried[pattern, i], round(goal), held)
        inside = sorted({(p, goal) for (p, _), (_, goal, held) in goals.items() if 0 < goal < held})
        found = {}
        if inside:
            rows = _cut_keys(marked.filter(F.col("class") == size_class), spark.createDataFrame(inside, "pattern string, rest long"))
            found = {(r["pattern"], r["rest"]): (r["last"], r["taken"]) for r in rows.collect()}  # one row per cut
        for (pattern, i), (wanted, goal, held) in goals.items():
            last, taken = (-1, 0) if goal <= 0 else (_ALL, held) if goal >= held else found[pattern, goal]
            carried[pattern, i] = wanted - taken
            out[pattern, size_class].append((*by_pattern[pattern][i][:2], last))
    return out


def mix(docs: DataFrame, members: Column, size: Column, key: list[str], weights=WEIGHTS, share: Fraction = Fraction(1),
        most: int = MAX_COPIES, seed: int = SEED) -> tuple[DataFrame, Plan]:
    """``docs`` with ``size``, ``shares`` (source and copies taken for it) and ``copies``, and the plan behind them.

    ``members`` is an array of source names (null names a source of its own), ``size`` a count; null counts as none.
    Sources get ``share`` of all words by weight, in the order of their code points, null last. The seeded order is by a
    hash of the columns ``key``; rows equal in them are taken alike. Documents of no source or no words get no copy or,
    where they are, none that counts. All other columns stay, whatever their names; ``size``, ``shares`` and ``copies`` are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    pattern, place, cuts_of, of_class = unused(docs, "_pattern", "_key", "_cuts", "_class")
    rows = docs.withColumns({
        "size": F.coalesce(size, F.lit(0)).cast("long"), pattern: F.to_json(members),
        place: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)})
    size_class = F.coalesce(*[F.when(F.col("size") > most_words, i) for i, most_words in enumerate(CLASSES)], F.lit(len(CLASSES)))
    marked = scratch.write(rows.select(F.col(pattern).alias("pattern"), members.alias("members"), "size",
                                       F.col(place).alias("key"), size_class.alias("class")), "marked")
    plan = plan_mix(marked.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")),
                    weights, share, most)
    table = spark.createDataFrame([(*k, cuts) for k, cuts in _settled(marked, plan).items()],
                                  f"{pattern} string, {of_class} int, {cuts_of} array<struct<source:string,whole:long,last:long>>")
    below = lambda cut: F.coalesce(cut["whole"] + (F.col(place) <= cut["last"]).cast("long"), F.lit(0))
    shares = F.transform(F.col(cuts_of), lambda cut, i: F.struct(
        cut["source"].alias("source"), (below(cut) - below(F.get(F.col(cuts_of), i - 1))).alias("copies")))
    out = (rows.withColumn(of_class, size_class).join(F.broadcast(table), [pattern, of_class], "left")
           .withColumn("shares", F.filter(F.coalesce(shares, F.array().cast("array<struct<source:string,copies:bigint>>")),
                                          lambda x: x["copies"] > 0))
           .withColumn("copies", F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x["copies"]))
           .drop(pattern, place, cuts_of, of_class))
    return out, plan

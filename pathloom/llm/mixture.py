"""Mixing sources to target weights by min-cost flow.

1. Equal texts are one document, which may belong to several sources; its membership pattern is the set of its sources
   that have a target. One copy of each text is measured in tokens. Documents shrink to one row per pattern.
2. A flow network routes tokens: pattern -> source -> total. Each further use of a pattern holds its tokens once more and
   costs more than the use before, (r - 1)^2 a token, so texts are repeated only where first uses are used up; a
   pattern has as many uses as the smallest cap of its sources, so no document is used more often than any of its
   sources allows. Costs lie on the first edge of a path only, so the flow of least cost is the maximum flow of the
   first uses, enlarged by that of the second uses, and so on.
3. Quotas are the target shares of the total (by default the tokens of all documents with a target). They are soft:
   where sources cannot fill theirs, these give all that they have at their caps, and what is lacking is spread over the
   others in the proportion of their targets (shares are max-min fair, exactly). The report names the shortage.
4. Documents of a pattern lie on a line in seeded hash order; the flow cuts each use of the line into intervals, one per
   source. Positions come from token sums per hash bucket and a running sum within a bucket; the number of buckets
   follows the number of documents, so no task holds a pattern. A document across a cut goes to the side that it brings
   closest to its quota, large ones first.

What reaches the driver is one row per pattern (at most 2^targets - 1; some tens of bytes a source), one per cut and one
per source. Tested with 8,191 patterns of 13 sources.

Defined results: source names are trimmed and lower-cased; documents without source, without text or without tokens
take no part, as do sources without a target; a target without documents gets nothing and is reported as short;
empty tables give an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tokenizer import VOCABULARY, count_tokens
from pathloom.operators.blocks import reliable

DOCUMENTS_PER_BUCKET = 50_000

Pattern = tuple[str, ...]


class Flow:
    """Maximum flow from patterns to sources, by shortest augmenting paths over the sources.

    The flow is one matrix (patterns x sources); a path moves tokens from source to source by patterns that belong to
    both, all such patterns at once, so the number of paths depends on the number of sources only.
    """

    def __init__(self, member: np.ndarray):
        self.member, self.flow = member.astype("int64"), np.zeros(member.shape, "int64")

    def exchange(self) -> np.ndarray:
        """Tokens that could move from each source to each other one."""
        return self.flow.T @ self.member

    def _move(self, amount: int, have: np.ndarray, to: int, source: int | None) -> None:
        upto = np.cumsum(have)
        take = np.clip(amount - (upto - have), 0, have)
        self.flow[:, to] += take
        if source is not None:
            self.flow[:, source] -= take

    def fill(self, room: np.ndarray, quota: np.ndarray) -> None:
        """Routes all that fits: ``room`` tokens of each pattern, ``quota`` tokens of each source."""
        while True:
            left, need = room - self.flow.sum(1), quota - self.flow.sum(0)
            if not (need > 0).any():
                return
            supply, between = left @ self.member, self.exchange()
            seen = {int(k): None for k in np.flatnonzero(supply > 0)}
            queue, end = list(seen), None
            for k in queue:
                if need[k] > 0:
                    end = k
                    break
                for j in np.flatnonzero(between[k] > 0):
                    if int(j) not in seen:
                        seen[int(j)] = k
                        queue.append(int(j))
            if end is None:
                return
            path = [end]
            while seen[path[-1]] is not None:
                path.append(seen[path[-1]])
            amount = min(int(need[end]), int(supply[path[-1]]), *(int(between[i, j]) for j, i in zip(path, path[1:])))
            for j, i in zip(path, path[1:]):
                self._move(amount, self.flow[:, i] * self.member[:, j], j, i)
            self._move(amount, left * self.member[:, path[-1]], path[-1], None)


def _apportioned(weights: np.ndarray, total: int) -> np.ndarray:
    """Integers of the given sum in proportion to weights, by largest remainder."""
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype("int64")
    order = np.argsort(out - exact, kind="stable")
    out[order[: total - int(out.sum())]] += 1
    return out


def fair_quotas(member: np.ndarray, most: np.ndarray, share: np.ndarray, total: int) -> np.ndarray:
    """Tokens of each source nearest to its share of ``total``: max-min fair relative to the shares.

    ``most``: tokens of each pattern with all its uses. Where a set of sources cannot fill its quotas, it takes all tokens
    of its patterns, and the rest of the total goes to the other sources, each part by itself.
    """
    out = np.zeros(len(share), "int64")
    todo = [(np.arange(len(share)), np.arange(len(most)), total)]
    while todo:
        own, rows, amount = todo.pop()
        if not len(own) or not len(rows):
            continue
        amount = min(amount, int(most[rows].sum()))
        want = _apportioned(share[own], amount)
        f = Flow(member[np.ix_(rows, own)])
        f.fill(most[rows], want)
        lacking = want > f.flow.sum(0)
        if not lacking.any():
            out[own] = want
            continue
        between = f.exchange() > 0
        while (grown := lacking | (between & lacking).any(1)).sum() > lacking.sum():
            lacking = grown
        theirs = f.member[:, lacking].any(1)
        todo.append((own[lacking], rows[theirs], int(most[rows[theirs]].sum())))
        todo.append((own[~lacking], rows[~theirs], amount - int(most[rows[theirs]].sum())))
    return out


def route(patterns: dict[Pattern, int], targets: dict[str, tuple[float, int]], total: int | None = None, keep_shares: bool = False) -> tuple[dict[tuple[Pattern, str], int], int]:
    """Tokens for each (pattern, source), and the total aimed at.

    ``patterns``: tokens by membership; ``targets``: (share, most uses) by source. Without ``total`` it is the tokens of
    all patterns; with ``keep_shares`` it shrinks to the largest total at which all quotas can be met.
    """
    have = sorted({s for p, n in patterns.items() if n > 0 for s in p if targets[s][0] > 0 and targets[s][1] > 0})
    ways = [(p, n, min(targets[s][1] for s in p)) for p, n in sorted(patterns.items()) if n > 0 and any(s in have for s in p)]
    if not have:
        return {}, 0
    share = np.array([targets[s][0] for s in have])
    place = {s: i for i, s in enumerate(have)}
    member = np.zeros((len(ways), len(have)), bool)
    for i, (p, _, _) in enumerate(ways):
        member[i, [place[s] for s in p if s in place]] = True
    size, caps = np.array([n for _, n, _ in ways], "int64"), np.array([c for _, _, c in ways], "int64")
    total = int(size.sum()) if total is None else total
    if keep_shares:

        def met(t: int) -> bool:
            f, want = Flow(member), _apportioned(share, t)
            f.fill(size * caps, want)
            return bool((f.flow.sum(0) == want).all())

        low, high = 0, total
        while low < high:
            t = (low + high + 1) // 2
            low, high = (t, high) if met(t) else (low, t - 1)
        total = low
    quota = fair_quotas(member, size * caps, share, total)
    f = Flow(member)
    for uses in range(1, int(caps.max(initial=0)) + 1):
        f.fill(size * np.minimum(uses, caps), quota)
        if (f.flow.sum(0) == quota).all():
            break
    return {(ways[i][0], have[k]): int(f.flow[i, k]) for i, k in np.argwhere(f.flow > 0)}, total


def _owners(rows: list, quota: dict[str, int], full: dict[str, int]) -> list[tuple]:
    """Gives each document across a cut to one side (or to none): ``(doc_id, source, tokens)``."""
    lacks = {s: n - full.get(s, 0) for s, n in quota.items()}
    out = []
    for r in sorted(rows, key=lambda r: (-r["tokens"], r["key"], r["r"])):
        gain = {c: abs(lacks[c]) - abs(lacks[c] - r["tokens"]) for c in sorted(r["sources"])}
        best = max(gain, key=gain.get)
        if gain[best] > 0:
            lacks[best] -= r["tokens"]
            out.append((next(d["doc_id"] for d in r["in"] if d["source"] == best), best, r["tokens"]))
    return out


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY, keep_shares: bool = False, documents_per_bucket: int = DOCUMENTS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id, source, copies, tokens``) and its report (``source, target_share, max_repeats, wanted_tokens,
    quota_tokens, tokens, actual_share, documents, most_copies, short_tokens``).

    ``wanted_tokens`` is the target share of the total, ``quota_tokens`` what the flow gives, ``short_tokens`` what is
    lacking. ``total`` and ``keep_shares``: see ``route``.
    """
    spark = docs.sparkSession
    name = lambda c: F.lower(F.trim(c))
    goal = targets.where(F.col("source").isNotNull()).groupBy(name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    aims = {r["source"]: (float(r["share"] or 0.0), int(r["most"] or 0)) for r in goal.collect()}
    known = docs.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", name("source").alias("source"), "text")
    known = known.where(F.col("source").isin(*aims) if aims else F.lit(False)).withColumn("key", F.md5("text"))
    # equal texts meet before they are measured (partial aggregation first, so a text with a third of all rows is one row a task)
    ids = known.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("in"))
    measured = count_tokens(known.select("key", "text").dropDuplicates(["key"]), ["key"], vocabulary=vocabulary)
    texts = reliable(ids.join(measured.where("tokens > 0"), "key").withColumns({"place": F.xxhash64(F.col("key"), F.lit(seed)), "pattern": F.col("in.source")}))
    per = {tuple(r["pattern"]): (r["n"], r["d"]) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n"), F.count("*").alias("d")).collect()}
    flow, size = route({p: n for p, (n, _) in per.items()}, aims, total, keep_shares)

    plan: dict[Pattern, list[tuple[int, str, int, int]]] = {}
    ends: dict[Pattern, int] = {}
    quota: dict[str, int] = {}
    for (p, s), n in sorted(flow.items()):
        quota[s] = quota.get(s, 0) + n
        at, upto, length = ends.get(p, 0), ends.get(p, 0) + n, per[p][0]
        ends[p] = upto
        while at < upto:  # the flow goes on in the next use of the line where one is used up
            use, begin = divmod(at, length)
            stop = min(upto - use * length, length)
            plan.setdefault(p, []).append((use + 1, s, begin, stop))
            at = use * length + stop
    lines = spark.createDataFrame([(list(p), c) for p, c in plan.items()], "pattern array<string>, cuts array<struct<r:int,source:string,a:long,z:long>>")
    buckets = max(math.ceil(sum(d for _, d in per.values()) / documents_per_bucket), 1)
    texts = texts.withColumn("bucket", F.pmod(F.shiftright("place", 32), F.lit(buckets)))
    prior = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    meets = lambda a, z: F.filter("cuts", lambda c: (c["a"] < z) & (c["z"] > a))
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(prior(["pattern"], "bucket")), F.lit(0)))
    begun = base.join(lines, "pattern").withColumn("cuts", meets(F.col("base"), F.col("base") + F.col("n"))).where(F.size("cuts") > 0).drop("n")
    # joined by (pattern, bucket), the window's keys, so a pattern with a third of all texts is spread over its buckets
    start = F.col("base") + F.coalesce(F.sum("tokens").over(prior(["pattern", "bucket"], "place", "key")), F.lit(0))
    placed = texts.join(begun, ["pattern", "bucket"]).withColumn("start", start).withColumn("cuts", meets(F.col("start"), F.col("start") + F.col("tokens"))).where(F.size("cuts") > 0)
    inside = lambda c: (c["a"] <= F.col("start")) & (F.col("start") + F.col("tokens") <= c["z"])
    placed = reliable(placed.select("key", "in", "tokens", F.filter("cuts", inside).alias("whole"), F.filter("cuts", lambda c: ~inside(c)).alias("part")))
    taken = placed.select("in", "tokens", F.explode("whole.source").alias("source"))
    full = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    across = placed.where(F.size("part") > 0).select("key", "in", "tokens", F.explode("part").alias("c")).groupBy("key", "in", "tokens", "c.r").agg(F.collect_set("c.source").alias("sources"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    owned = spark.createDataFrame(_owners(across.collect(), quota, full), f"doc_id {kind}, source string, tokens long")  # two a cut at most
    chosen = taken.select(F.filter("in", lambda x: x["source"] == F.col("source"))[0]["doc_id"].alias("doc_id"), "source", "tokens").unionByName(owned)
    out = chosen.groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("copies"), F.max("tokens").alias("tokens"))

    got = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    got = got.withColumn("all", F.sum("got").over(Window.partitionBy()))  # one row per target
    weight = sum(a[0] for a in aims.values()) or 1.0
    wanted = [(s, a[0], a[1], round(a[0] / weight * size), quota.get(s, 0)) for s, a in sorted(aims.items())]
    told = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int, wanted_tokens long, quota_tokens long")
    report = told.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "wanted_tokens", "quota_tokens", F.coalesce("got", F.lit(0)).alias("tokens"), F.coalesce(F.col("got") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.greatest(F.col("wanted_tokens") - F.col("quota_tokens"), F.lit(0)).alias("short_tokens"),
    )
    return out, report

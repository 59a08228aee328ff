"""Problem 9: a mixture of sources with target shares, by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.llm import sizes
from lumbra.llm.common import running_total
from lumbra.session import cut


class Flow:
    """Min-cost flow with whole capacities, by successive shortest paths; the networks here have some hundred edges."""

    def __init__(self, n: int) -> None:
        self.adj: list[list[list[int]]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int, cost: int = 0) -> tuple[int, int]:
        self.adj[a].append([b, capacity, cost, len(self.adj[b])])
        self.adj[b].append([a, 0, -cost, len(self.adj[a]) - 1])
        return a, len(self.adj[a]) - 1

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist: dict[int, int] = {s: 0}
            back: dict[int, tuple[int, int]] = {}
            queue, queued = deque([s]), {s}
            while queue:
                u = queue.popleft()
                queued.discard(u)
                for i, (v, cap, cost, _) in enumerate(self.adj[u]):
                    if cap > 0 and (v not in dist or dist[u] + cost < dist[v]):
                        dist[v], back[v] = dist[u] + cost, (u, i)
                        if v not in queued:
                            queue.append(v)
                            queued.add(v)
            if t not in dist:
                return total
            push, v = None, t
            while v != s:
                u, i = back[v]
                push = self.adj[u][i][1] if push is None else min(push, self.adj[u][i][1])
                v = u
            v = t
            while v != s:
                u, i = back[v]
                e = self.adj[u][i]
                e[1] -= push
                self.adj[v][e[3]][1] += push
                v = u
            total += push


#: What a token that a source lacks costs the flow: more than any repetition.
LACK = 10_000


def route(patterns: dict[tuple[str, ...], int], share: dict[str, Fraction], repeats: dict[str, int], size: int, short: frozenset[str] = frozenset()) -> tuple[int, int, dict[tuple[tuple[str, ...], str], int]]:
    """(tokens wanted, tokens found, tokens that each pattern gives each source) for quotas of the sources' shares of size.

    The k-th use of a pattern's texts costs k - 1; a source uses a text at most its cap of times; what can't be found costs most.
    Sources in short may lack tokens: they come after the others and don't count in what is wanted and found.
    """
    quota = {s: int(share[s] * size) for s in share}
    names, keys = sorted(share), sorted(patterns)
    at = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    flow, edges = Flow(2 + len(keys) + len(names)), {}
    for i, p in enumerate(keys, 2):
        for k in range(max(repeats[s] for s in p)):
            flow.edge(0, i, patterns[p], k)
        for s in p:
            edges[p, s] = flow.edge(i, at[s], patterns[p] * repeats[s])
    for s in names:
        flow.edge(0, at[s], quota[s], LACK if s in short else 2 * LACK)
        flow.edge(at[s], 1, quota[s])
    flow.run(0, 1)
    used = {(p, s): patterns[p] * repeats[s] - flow.adj[a][i][1] for (p, s), (a, i) in edges.items()}
    return sum(quota[s] for s in names if s not in short), sum(n for (_, s), n in used.items() if s not in short), used


def largest(patterns: dict, share: dict, repeats: dict, short: frozenset[str] = frozenset(), most: int | None = None) -> tuple[int, dict]:
    """The largest size, most at most, at which the quotas of all sources but the short ones can be filled, and the routes for it."""
    held = float(sum(n for s, n in share.items() if s not in short))
    low, high, best = 0, int(sum(n * max(repeats[s] for s in p) for p, n in patterns.items()) / max(held, 0.01)) + 2 + len(share), {}
    high = high if most is None else min(high, most + 1)
    while high - low > 1:
        mid = (low + high) // 2 if most is None or high <= most or low else high - 1
        want, have, used = route(patterns, share, repeats, mid, short)
        if have >= want:
            low, best = mid, used
        else:
            high = mid
    return low, best


def _texts(docs: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(k1, k2, tokens, members): distinct texts that a named source has, with the smallest doc_id in each of its sources."""
    named = docs.join(F.broadcast(targets.select("source").distinct()), "source").filter("doc_id is not null and text is not null")
    digest = F.unhex(F.md5("text"))
    half = [F.conv(F.hex(F.substring(digest, i, 8)), 16, -10).cast("long") for i in (1, 9)]
    rows = named.select("doc_id", "source", half[0].alias("k1"), half[1].alias("k2"), "text")
    rows = sizes.sized(rows, ["doc_id", "source", "k1", "k2"], "text", path).filter("tokens > 0")
    once = rows.groupBy("k1", "k2", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    return once.groupBy("k1", "k2").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"))


#: Named sources that a mixture takes; the sums of their texts by membership go through the driver, at most 2^16 of them.
MOST_SOURCES = 16
#: Single texts that are put in or taken out for each source, to bring its share from within half a text a stretch still nearer.
CORRECTIONS = 8


def mixture(docs: DataFrame, source_targets: DataFrame, seed: int = 0, size: int | None = None, part: float | None = None, path: str = sizes.RANKS) -> DataFrame:
    """(source, doc_id, uses, tokens): how often the mixture has each document's text, and the tokens of one use.

    Without a size the mixture is the largest one in which every source that has texts holds its share. With a wanted size in tokens, or a
    part of the tokens that the sources have, a source that can't reach its share of that size with all its texts at its cap is short: it gives
    all it has, and the others hold their shares of the size, so their shares to each other are exact. If they can't because they hold the same
    texts, the size is the largest at which they can. Shares of absent sources go to the others in proportion.
    Equal texts are one, whatever documents and sources hold them: tokens are summed by the set of sources that have them (at most
    2^sources - 1 sums, of MOST_SOURCES sources at most, else an error), a min-cost flow over these sums fixes what each gives to which source, and
    the texts of a pattern, in seeded random order on a line, are taken from the source's stretch of it. A text belongs to where its middle lies;
    then each source's difference from its quota is made smaller by one text after the other.
    Texts without a token and sources that aren't named are not used; a share or cap that is null or not positive counts as absent.
    """
    spark: SparkSession = docs.sparkSession
    targets = source_targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (Fraction(str(r["target_share"])), int(r["max_repeats"])) for r in targets.limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    texts = cut(_texts(docs.select("doc_id", "source", "text"), targets, path).withColumn("pattern", F.col("members.source")), "texts")
    patterns = {tuple(r["pattern"]): int(r["n"]) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    present = {s for p in patterns for s in p}
    whole = sum((wanted[s][0] for s in present), Fraction(0))
    share = {s: wanted[s][0] / whole for s in present}
    repeats = {s: wanted[s][1] for s in present}
    most, short = size if part is None else int(part * sum(patterns.values())), frozenset()
    if most is not None:
        short = frozenset(s for s in present if sum(n for p, n in patterns.items() if s in p) * repeats[s] < int(share[s] * most))
        short = short if short < present else frozenset()
    reached, routes = largest(patterns, share, repeats, short, most) if present else (0, {})
    stretches, at = [], dict.fromkeys(patterns, 0)
    for (p, s), n in sorted(routes.items()):
        if n:
            stretches.append((list(p), s, at[p], at[p] + n, patterns[p]))
            at[p] += n
    lines = spark.createDataFrame(stretches, "pattern array<string>, source string, lo long, hi long, lap long")
    order = [F.xxhash64("k1", F.lit(seed)), F.col("k1"), F.col("k2")]
    line = running_total(texts.withColumn("p", F.array_join("pattern", "\x1f")), ["p"], order, "tokens", "upto").withColumn("start", F.col("upto") - F.col("tokens") + F.floor(F.col("tokens") / 2))
    met = line.join(F.broadcast(lines), "pattern")
    laps = lambda x: F.ceil((F.col(x) - F.col("start")) / F.col("lap"))
    met = met.withColumn("uses", (F.greatest(laps("hi"), F.lit(0)) - F.greatest(laps("lo"), F.lit(0))).cast("int")).filter("uses > 0")
    own = F.filter("members", lambda m: m["source"] == F.col("source"))
    used = cut(met.select("k1", "k2", "source", F.element_at(own, 1)["doc_id"].alias("doc_id"), "uses", "tokens"), "used")
    return _corrected(texts, used, {s: int(share[s] * reached) for s in present - short}, repeats, seed)


def _corrected(texts: DataFrame, used: DataFrame, quota: dict[str, int], repeats: dict[str, int], seed: int) -> DataFrame:
    """used with single texts put in or taken out, as long as that brings a source's tokens nearer to its quota. Each step is one aggregate to a row for each source."""
    spark = texts.sparkSession
    if not quota:
        return used.select("source", "doc_id", "uses", "tokens")
    each = texts.select("k1", "k2", "tokens", F.explode("members").alias("m")).select("k1", "k2", "m.source", "m.doc_id", "tokens")
    # a text may be used as often as the largest cap of its sources allows, in all of them together
    allowed = spark.createDataFrame(sorted(repeats.items()), "source string, cap int")
    each = each.join(F.broadcast(allowed), "source").join(used.drop("tokens", "doc_id"), ["k1", "k2", "source"], "left").fillna(0, ["uses"])
    room = each.groupBy("k1", "k2").agg(F.sum("uses").alias("all"), F.max("cap").alias("most"))
    each = cut(each.join(room, ["k1", "k2"]).select("k1", "k2", "source", "doc_id", "tokens", "uses", "cap", "all", "most"), "each")
    have = {r["source"]: int(r["n"]) for r in used.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("n")).collect()}
    changes: dict[tuple[int, int, str], int] = {}
    for _ in range(CORRECTIONS):
        gap = {s: n - have.get(s, 0) for s, n in quota.items() if n != have.get(s, 0)}
        if not gap:
            break
        gaps = spark.createDataFrame(sorted(gap.items()), "source string, gap long")
        done = spark.createDataFrame([(*k, n) for k, n in changes.items()], "k1 long, k2 long, source string, change int")
        total = done.groupBy("k1", "k2").agg(F.sum("change").cast("int").alias("moved"))
        now = each.join(F.broadcast(gaps), "source").join(F.broadcast(done), ["k1", "k2", "source"], "left").join(F.broadcast(total), ["k1", "k2"], "left").fillna(0, ["change", "moved"])
        uses = F.col("uses") + F.col("change")
        more = F.when((F.col("gap") > 0) & (uses < F.col("cap")) & (F.col("all") + F.col("moved") < F.col("most")), F.abs(F.col("gap") - F.col("tokens")))
        less = F.when((F.col("gap") < 0) & (uses > 0), F.abs(F.col("gap") + F.col("tokens")))
        now = now.withColumn("left", F.coalesce(more, less)).filter(F.col("left") < F.abs("gap"))
        best = now.groupBy("source").agg(F.min(F.struct("left", F.xxhash64("k1", F.lit(seed)).alias("h"), "k1", "k2", "tokens")).alias("x")).select("source", "x.*").orderBy("source").collect()
        taken = set()
        for r in best:
            if (r["k1"], r["k2"]) not in taken:
                taken.add((r["k1"], r["k2"]))
                sign = 1 if gap[r["source"]] > 0 else -1
                changes[r["k1"], r["k2"], r["source"]] = changes.get((r["k1"], r["k2"], r["source"]), 0) + sign
                have[r["source"]] = have.get(r["source"], 0) + sign * r["tokens"]
        if not best:
            break
    done = spark.createDataFrame([(*k, n) for k, n in changes.items()], "k1 long, k2 long, source string, change int")
    out = each.join(F.broadcast(done), ["k1", "k2", "source"], "left").withColumn("uses", F.col("uses") + F.coalesce("change", F.lit(0)))
    return out.filter("uses > 0").select("source", "doc_id", "uses", "tokens")


def shares(mixed: DataFrame, source_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_uses, short) of all named sources, those without texts with 0.

    short marks a source with less than its share of the present sources' shares, beyond one of its texts in the mixture.
    """
    sums = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.max("tokens").alias("longest"))
    named = source_targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    met = named.join(F.broadcast(sums), "source", "left")
    whole = met.agg(F.sum("tokens").alias("whole"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("held"))
    met = met.join(F.broadcast(whole), F.lit(True), "left")
    got, due = F.coalesce("tokens", F.lit(0)), F.col("target_share") / F.col("held") * F.col("whole")
    short = F.coalesce(got + F.col("longest") < due, got == 0)
    return met.select("source", "target_share", "max_repeats", got.cast("long").alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 4).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), short.alias("short"))

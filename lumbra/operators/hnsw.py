"""Approximate search by navigable small-world graphs: one graph for each part of the vectors, of bounded size, kept as a table of nodes."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbra.operators.keyword import top
from lumbra.operators.vector import _blocks
from lumbra.session import cut

#: Links of a node on the upper levels (twice as many on the lowest), candidates when a node is put in, and vectors of one graph.
M, EF_CONSTRUCTION, PART = 16, 200, 20_000
_NODE = "part int, node int, vector array<double>, level int, links array<array<int>>"


def level(id_: Column, m: int = M) -> Column:
    """The level of a node, drawn from the exponential distribution with scale 1 / ln(m) by the id's MD5: the same in every run."""
    u = (F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("double") + 1) / 2.0**32
    return F.floor(-F.ln(u) / math.log(m)).cast("int")


class Graph:
    """One graph in memory. Distances are Euclidean; rows are vectors, links[node][level] are nodes."""

    def __init__(self, x: np.ndarray, levels: list[int], links: list[list[list[int]]] | None = None, m: int = M, ef: int = EF_CONSTRUCTION) -> None:
        self.x, self.levels, self.m, self.ef = x, levels, m, ef
        self.links = links if links is not None else [[[] for _ in range(n + 1)] for n in levels]
        self.entry = int(np.argmax(levels)) if len(levels) else -1

    def far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        d = self.x[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def near(self, q: np.ndarray, start: list[int], ef: int, at: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on a level, nearest first, by following links from the start."""
        seen = set(start)
        found = [(-d, n) for d, n in zip(self.far(q, start), start, strict=True)]
        heapq.heapify(found)
        todo = [(-d, n) for d, n in found]
        heapq.heapify(todo)
        while todo:
            d, n = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [v for v in self.links[n][at] if v not in seen]
            if not new:
                continue
            seen.update(new)
            for e, v in zip(self.far(q, new), new, strict=True):
                if len(found) < ef or e < -found[0][0]:
                    heapq.heappush(todo, (e, v))
                    heapq.heappush(found, (-e, v))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, n) for d, n in found)

    def chosen(self, q: np.ndarray, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Spread neighbours: one that lies nearer to a chosen one than to q comes only if there is room left."""
        kept: list[int] = []
        rest: list[int] = []
        for d, n in candidates:
            if len(kept) == most:
                break
            (kept if not kept or self.far(self.x[n], kept).min() > d else rest).append(n)
        return kept + rest[: most - len(kept)]

    def build(self) -> Graph:
        entry = -1
        for n, high in enumerate(self.levels):
            if entry < 0:
                entry = n
                continue
            q, start = self.x[n], [entry]
            for at in range(self.levels[entry], high, -1):
                start = [self.near(q, start, 1, at)[0][1]]
            for at in range(min(high, self.levels[entry]), -1, -1):
                found = self.near(q, start, self.ef, at)
                most = 2 * self.m if at == 0 else self.m
                self.links[n][at] = self.chosen(q, found, self.m)
                for v in self.links[n][at]:
                    self.links[v][at].append(n)
                    if len(self.links[v][at]) > most:
                        around = self.links[v][at]
                        order = sorted(zip(self.far(self.x[v], around).tolist(), around, strict=True))
                        self.links[v][at] = self.chosen(self.x[v], order, most)
                start = [v for _, v in found]
            if high > self.levels[entry]:
                entry = n
        self.entry = entry
        return self

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for at in range(self.levels[self.entry], 0, -1):
            start = [self.near(q, start, 1, at)[0][1]]
        return self.near(q, start, ef, 0)


def _searched(shared, k: int, ef: int):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        ids, q = shared.value
        b = b.sort_values("node").reset_index(drop=True)
        x = np.stack(b["vector"].to_numpy())
        rows = []
        if x.shape[1] == q.shape[1]:
            g = Graph(x, b["level"].tolist(), [[list(at) for at in n] for n in b["links"]])
            gone, names = b["gone"].to_numpy(), b["id"].to_numpy()
            # deleted nodes take places among the nearest
            wide = max(ef, k) + int(gone.sum() * (ef + k) / len(b))
            for name, v in zip(ids, q, strict=True):
                rows += [(name, names[n], 1 / (1 + d**0.5)) for d, n in [x for x in g.search(v, wide) if not gone[x[1]]][:k]]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"])

    return run


class Hnsw:
    """nodes (part, node, id, vector, level, links, gone): the graphs as a table. Parts have about PART vectors, so a graph fits into a task whatever the table's size."""

    def __init__(self, nodes: DataFrame, m: int = M) -> None:
        self.nodes, self.m = nodes, m

    @classmethod
    def build(cls, vectors: DataFrame, m: int = M, ef: int = EF_CONSTRUCTION, part: int = PART) -> Hnsw:
        """vectors: id, vector, of one length. Null vectors are left out; of rows with equal ids the greatest vector counts."""
        rows = cut(vectors.filter("id is not null and vector is not null").groupBy("id").agg(F.max(F.col("vector").cast("array<double>")).alias("vector")), "vectors")
        parts = max(1, -(-rows.count() // part))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("level", level(F.col("id"), m))
        kind = dict(rows.dtypes)["id"]

        def grow(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id").reset_index(drop=True)
            g = Graph(np.stack(b["vector"].to_numpy()), b["level"].tolist(), m=m, ef=ef).build()
            return pd.DataFrame({"part": b["part"], "node": range(len(b)), "id": b["id"], "vector": b["vector"], "level": b["level"], "links": g.links, "gone": False})

        schema = _NODE.replace("node int,", f"node int, id {kind},") + ", gone boolean"
        return cls(cut(rows.groupBy("part").applyInPandas(grow, schema), "graphs"), m)

    def delete(self, ids: DataFrame) -> Hnsw:
        """Nodes of these ids are still passed through, but never found."""
        gone = self.nodes.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
        return Hnsw(gone.withColumn("gone", F.col("gone") | F.coalesce("_gone", F.lit(False))).select(*self.nodes.columns), self.m)

    def levels(self) -> DataFrame:
        """(level, nodes, connections): how many nodes end on each level, and their links on all levels."""
        links = F.aggregate("links", F.lit(0), lambda s, x: s + F.size(x))
        return self.nodes.filter(~F.col("gone")).groupBy("level").agg(F.count("*").alias("nodes"), F.sum(links).alias("connections"))

    def search(self, queries: DataFrame, k: int = 10, ef: int = 50) -> DataFrame:
        """(query_id, id, score, rank): score is 1 / (1 + distance). Each part's graph is searched for the max(ef, k) nearest, the best k of all parts come out."""
        key, kind = dict(self.nodes.dtypes)["id"], dict(queries.dtypes)["query_id"]
        schema = f"query_id {kind}, id {key}, score double"
        spark, found = self.nodes.sparkSession, None
        for block in _blocks(queries):
            shared = spark.sparkContext.broadcast(block)

            hits = self.nodes.groupBy("part").applyInPandas(_searched(shared, k, ef), schema)
            found = hits if found is None else found.unionByName(hits)
        return top(found if found is not None else spark.createDataFrame([], schema), k)

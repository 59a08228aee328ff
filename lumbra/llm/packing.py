"""Problem 8: filling containers of fixed capacity, by best-two-fit."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbra.llm import sizes
from lumbra.session import cut

#: Items that one task packs together, and how full a container of the first round must be to stay.
SHARD = 20_000
FULL = 0.97


def best_two_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; no item is larger than the capacity.

    A container takes the largest item that still fits, until none does. If room is left, its smallest item is given back for the two
    unpacked items that fit the wider gap most tightly, if they fill it better. Equal sizes are taken in order of position.
    """
    where = np.full(len(size), -1, np.int64)
    stock: dict[int, list[int]] = {}
    for i in np.argsort(-size, kind="stable")[::-1]:
        stock.setdefault(int(size[i]), []).append(int(i))
    avail = sorted(stock)

    def take(s: int) -> int:
        i = stock[s].pop()
        if not stock[s]:
            del stock[s]
            avail.pop(bisect_right(avail, s) - 1)
        return i

    def give(s: int, i: int) -> None:
        if s not in stock:
            stock[s] = []
            avail.insert(bisect_right(avail, s), s)
        stock[s].append(i)

    number = 0
    while avail:
        room, inside = capacity, []
        while avail and avail[0] <= room:
            s = avail[bisect_right(avail, room) - 1]
            inside.append((s, take(s)))
            room -= s
        if room and len(inside) > 1 and avail:
            low = min(inside)
            gap = room + low[0]
            fit = np.array(avail[: bisect_right(avail, gap)])
            if len(fit):
                j = np.searchsorted(fit, gap - fit, "right") - 1
                ok = j >= 0
                a, b = fit[ok], fit[j[ok]]
                ok = (a != b) | (np.array([len(stock[x]) for x in a.tolist()], int) > 1)
                if ok.any():
                    k = int(np.argmax(np.where(ok, a + b, -1)))
                    if a[k] + b[k] > low[0]:
                        inside.remove(low)
                        pair = [(int(a[k]), take(int(a[k]))), (int(b[k]), take(int(b[k])))]
                        inside += pair
                        give(*low)
        for _, i in inside:
            where[i] = number
        number += 1
    return where


def _pack(label: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        capacity = int(rows["capacity"].iloc[0])
        where = best_two_fit(rows["size"].to_numpy(np.int64), capacity)
        used = np.bincount(where, rows["size"].to_numpy(float)).astype(np.int64)
        out = rows[["budget_name", "capacity", "doc_id", "piece", "size"]].copy()
        out["container"] = pd.Series([f"{label}-{key[1]}-{w}" for w in where], dtype=object)
        out["used"] = used[where]
        return out

    return run


_OUT = "budget_name string, capacity int, doc_id long, piece int, size long, container string, used long"


def items(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """One line for each budget and text, or for each piece of a text that is longer than the capacity: all but the last are full containers."""
    windows = budgets.filter("capacity_tokens > 0").groupBy("budget_name").agg(F.max("capacity_tokens").alias("capacity"))
    # a line for each budget: one list of them all goes with every text
    every = windows.agg(F.collect_list(F.struct("budget_name", "capacity")).alias("every"))
    met = sized.join(F.broadcast(every), F.lit(True)).select("*", F.explode("every").alias("w")).select("doc_id", "tokens", "w.*")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    met = met.select("budget_name", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return met.select("budget_name", "capacity", "doc_id", "piece", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity").cast("long")).alias("size"))


def packed(docs: DataFrame, budgets: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = sizes.RANKS) -> DataFrame:
    """(budget_name, container, doc_id, piece, tokens): every text of every budget whole in one container, longer ones in pieces of the capacity.

    Items are packed in shards of about SHARD by a hash of the document; what lies in containers less than FULL full is packed again in fewer
    shards. The number of budgets is that of a small fixed table, which is broadcast. Null and empty texts have size 0 and fit anywhere;
    a budget without a positive capacity has no container.
    """
    sized = cut(sizes.sized(docs.withColumnRenamed(id_col, "doc_id"), ["doc_id"], text, path).filter("doc_id is not null"), "sizes")
    n = max(1, sized.count())
    every = items(sized, budgets)
    whole = every.filter("size = capacity").withColumn("container", F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece")).select("budget_name", "container", "doc_id", "piece", F.col("size").alias("tokens"))
    rest = every.filter("size < capacity")
    shard = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(max(1, -(-n // SHARD)) if k == 0 else max(1, -(-n // (8 * SHARD))))).cast("int")
    first = cut(rest.withColumn("shard", shard(0)).groupBy("budget_name", "shard").applyInPandas(_pack(0), _OUT), "packed")
    keep = first.filter(F.col("used") >= FULL * F.col("capacity"))
    again = first.filter(F.col("used") < FULL * F.col("capacity")).select("budget_name", "capacity", "doc_id", "piece", "size")
    again = again.withColumn("shard", shard(1)).groupBy("budget_name", "shard").applyInPandas(_pack(1), _OUT)
    out = keep.unionByName(again).select("budget_name", "container", "doc_id", "piece", F.col("size").alias("tokens"))
    return out.unionByName(whole)


def report(packing: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, containers, tokens, fill): how full the containers of each budget are on the whole."""
    sums = packing.groupBy("budget_name", "container").agg(F.sum("tokens").alias("tokens")).groupBy("budget_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.join(F.broadcast(budgets), "budget_name").select("budget_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))

"""Exact top-k by inner product: a KD-tree for every shard of the vectors.

Trees split at medians of the widest dimension and keep tight boxes.  A query
goes best-first through a shard's tree by the largest product that a box
allows, and leaves out boxes below its kth score so far.  That score travels: a
query first searches the shard that holds its own row, while that shard's tree is
built, and takes the kth score from there to all other shards.

Trees are files in the shared folder; queries go to them in blocks.
"""

from __future__ import annotations

import functools
import heapq
import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, write_atomically

#: Largest component that is kept as it is; beyond it values stay at this bound.
LIMIT = 2**62
LONG = 2**63 - 1


class KDTree:
    """Median-split tree with tight boxes over integer vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 128):
        n = len(vectors)
        order, spans, low, high, kids = np.arange(n), [(0, n)], [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            part = vectors[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            if b - a > leaf and part.shape[1] and (spread := high[-1] - low[-1]).max() > 0:
                dim, middle = int(np.argmax(spread)), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, dim], middle)]
                kids.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            else:
                kids.append(0)
            at += 1
        self.vectors, self.ids = vectors[order], ids[order]
        self.spans, self.low, self.high, self.kids = np.array(spans), np.array(low), np.array(high), np.array(kids)
        self._prepare()

    def _prepare(self) -> None:
        # doubles are exact while no sum can reach 2**53; beyond that Python's integers are
        self.peak = int(np.abs(self.vectors).max(initial=0))
        self.fast = tuple(a.astype(float) for a in (self.vectors, self.low, self.high))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, spans=self.spans, low=self.low, high=self.high, kids=self.kids)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> KDTree:
        tree = cls.__new__(cls)
        for k, v in np.load(io.BytesIO(raw)).items():
            setattr(tree, k, v)
        tree._prepare()
        return tree

    def search(self, queries: np.ndarray, own: list[int], k: int, kth: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each query up to k (score, id), best first, of scores not below its kth so far; rows of its own id are left out."""
        small = self.peak * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2**53
        vectors, low, high = self.fast if small else (a.astype(object) for a in (self.vectors, self.low, self.high))
        q = queries.astype(float if small else object)
        zero = q * 0
        bounds = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
        out = []
        for row, me, least in zip(range(len(q)), own, kth):
            best: list[tuple[int, int]] = []  # (score, -id), a heap with the worst on top
            bar = -np.inf if least is None else least
            queue = [(-bounds[row, 0], 0)]
            while queue and -queue[0][0] >= bar:
                _, node = heapq.heappop(queue)
                if kid := int(self.kids[node]):
                    for x in (kid, kid + 1):
                        if bounds[row, x] >= bar:
                            heapq.heappush(queue, (-bounds[row, x], x))
                    continue
                a, b = self.spans[node]
                scores = vectors[a:b] @ q[row]
                for i in np.flatnonzero(scores >= bar):
                    vid = int(self.ids[a + i])
                    item = (int(scores[i]), -vid)
                    if vid == me:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k and best[0][0] > bar:
                        bar = best[0][0]
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return out


@functools.lru_cache(maxsize=4)
def _tree(uri: str) -> KDTree:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return KDTree.load(f.read())


def _held(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null or non-finite part are left out."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    held = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x.cast("double")))).cast("long"))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k best other rows.

    Ties go to the smaller vec_id.  Rows with a null id, a null vector or a null
    or non-finite component take no part.  A query meets rows of its own length
    only.  Rows that repeat the query's id count as its own; other repeated rows
    are candidates each.  Components are held to +-2**62 and scores to the
    range of long.  An empty table gives no rows.
    """
    spark, folder = vectors.sparkSession, scratch(vectors.sparkSession, "kd")
    rows = quantized(vectors).withColumn("dim", F.size("v"))
    shards = max(1, -(-rows.count() // shard_rows))

    def build(pdf):
        import pandas as pd

        v, ids = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1), pdf["vec_id"].to_numpy(np.int64)
        dim, shard = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        tree = KDTree(v, ids)
        write_atomically(f"{folder}/{dim}-{shard}.npz", lambda out: out.write(tree.save()))
        mine = np.flatnonzero(ids % every == 0)
        if len(mine):  # one query for rows that repeat id and vector
            _, first = np.unique(np.column_stack([ids[mine], v[mine]]), axis=0, return_index=True)
            mine = mine[np.sort(first)]
        found = tree.search(v[mine], ids[mine].tolist(), k, [None] * len(mine))
        return pd.DataFrame({
            "query_id": ids[mine], "dim": dim, "home": shard, "q": pd.Series([x.tobytes() for x in v[mine]], dtype=object),
            "kth": pd.array([_held(f[-1][0]) if len(f) == k else None for f in found], "Int64"),
            "ids": pd.Series([[i for _, i in f] for f in found], dtype=object), "scores": pd.Series([[_held(s) for s, _ in f] for f in found], dtype=object),
        })

    # the groups are small in bytes and heavy in work, so they are dealt to stated numbers of tasks, which stay apart
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(min(shards, most), "dim", "shard")
    queries = stored(dealt.groupBy("dim", "shard").applyInPandas(build, "query_id long, dim int, home int, q binary, kth long, ids array<long>, scores array<long>"), "kd-queries")
    there = dealt.select("dim", "shard").distinct()
    blocks = max(1, -(-queries.count() // block_rows))

    def search(pdf):
        import pandas as pd

        tree = _tree(f"{folder}/{int(pdf['dim'].iloc[0])}-{int(pdf['shard'].iloc[0])}.npz")
        q = np.stack([np.frombuffer(x, np.int64) for x in pdf["q"]])
        kth = [None if pd.isna(x) else int(x) for x in pdf["kth"]]
        found = tree.search(q, pdf["query_id"].tolist(), k, kth)
        flat = [(i, x, vid, _held(s)) for i, x, f in zip(pdf["query_id"], pdf["q"], found) for s, vid in f]
        return pd.DataFrame(flat, columns=["query_id", "q", "vec_id", "score"])

    # a block of queries goes to each shard of its length but the one it began in
    sent = queries.select("query_id", "dim", "home", "q", "kth", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).join(there, "dim").where("shard != home")
    others = sent.repartition(min(blocks * shards, most), "dim", "block", "shard").groupBy("dim", "block", "shard").applyInPandas(search, "query_id long, q binary, vec_id long, score long")
    homes = queries.select("query_id", "q", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    homes = homes.toDF("query_id", "q", "vec_id", "score")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    best = others.unionByName(homes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

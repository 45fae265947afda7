"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors are integers, floor(scale * x). Rows are dealt into blocks; each block holds, per dimension, its rows sorted by
value and cut into posting segments of equal quantised value. For a query, the segments of all dimensions are taken by
descending impact, the most that a row of the segment can gain over the least in that dimension, each posting once. The
scores gathered so far are lower bounds; what is still to come in a dimension in which a row has not come up is at most
the impact of its next segment. Rows that can no longer reach a proven k-th score are not among the best; once enough
are ruled out, or no segment is left, the possible rest is scored exactly. The best of all blocks are merged by query.

A block is packed into one row, and so is a batch of queries. Every query has to meet every block, by what the search is
for; they meet in a Cartesian product of the two kept tables. Its tasks read their part of both from the shared folder, so
no copy of a query per block is shuffled, broadcast or sent to the driver. A task builds the index of a block once while
batches of queries pass by, and merges the best of its blocks by query before it writes them.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows without id, take no part;
components may be of any finite size: scores are compared exactly, and one that does not fit a long is returned as the
nearest long; only vectors of the query's length are its candidates, so empty ones (score 0) are each other's; of
repeated rows every row is a candidate for the others, and each query row gets its own answers; an empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, arrow_rows, pick, setting, tidy

BLOCK, QUERY_BLOCK = 8_192, 256
#: Values of one segment differ in this many low bits. A block is looked at after the part FIRST of its postings and then
#: after every part LOOK; the segments end when the bound leaves at most the part POSSIBLE of the rows, and those are
#: scored exactly, which costs less than as many postings.
SHIFT, FIRST, LOOK, POSSIBLE = 4, 0.375, 0.125, 0.5
LONG = (1 << 63) - 1
#: A task of the product writes out what it has once it holds the best of so many queries. Spark may spill the batches of
#: queries that wait for the next block beyond this number of them.
HELD, WAITING = 1 << 17, 16


class Block:
    """The index of one block: ids ascending among equal vectors, of which k + 1 are enough."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.lexsort((rows, ids))
        rows, ids, x = rows[order], ids[order], np.ascontiguousarray(x[order])
        if not x.shape[1]:
            x = np.zeros((len(x), 1))
        self.rows, self.ids, self.k = rows, ids, k
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(self.x) + 1))
        self.members = [by[a : min(b, a + k + 1)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.n, self.d = self.x.shape
        self.largest = float(np.abs(self.x).max())
        # postings, dimension after dimension, by value; and their segments
        order = np.argsort(self.x, axis=0, kind="stable").T
        value = np.take_along_axis(self.x.T, order, axis=1)
        level = np.floor(value / (1 << SHIFT))
        new = np.concatenate((np.ones((self.d, 1), dtype=bool), level[:, 1:] != level[:, :-1]), axis=1).ravel()
        # within a dimension, segments of descending impact are ever lower (or, for a negative weight, higher) places
        self.post, self.value = np.ascontiguousarray(order, dtype=np.intp), np.ascontiguousarray(value)
        small = np.int16 if self.n < 1 << 15 else np.int64
        self.place = np.empty((self.d, self.n), dtype=small)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=small)[None, :], axis=1)
        self.begin = np.flatnonzero(new)
        self.length = np.diff(np.append(self.begin, self.n * self.d))
        self.dim = self.begin // self.n
        flat = value.ravel()
        self.low, self.high = flat[self.begin], flat[self.begin + self.length - 1]
        self.least, self.most = value[:, 0], value[:, -1]
        self.taken = 0

    def search(self, q: np.ndarray, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) for a query whose own row is not a candidate."""
        q = q if len(q) else np.zeros(1)
        # integers below 2^53 are exact in doubles; beyond, bounds get a margin and scores are Python integers
        whole = self.d * self.largest * float(np.abs(q).max()) < 1 << 53
        k = min(self.k + 1, self.n)  # one may be the query's own
        base = np.minimum(q * self.least, q * self.most)  # the least a dimension can give
        ends = np.maximum(np.abs(q * self.least), np.abs(q * self.most)).sum()
        margin = 0.0 if whole else ends * 2.0**-40
        qs = q[self.dim]
        impact = np.maximum(qs * self.low, qs * self.high) - base[self.dim]
        by = np.argsort(-impact, kind="stable")
        by = by[impact[by] > 0]  # segments of no impact add nothing
        dim, impact, length = self.dim[by], impact[by], self.length[by]
        work = np.cumsum(length)
        score, after, up = np.full(self.n, base.sum()), np.zeros(self.d), q >= 0
        possible = np.arange(self.n)
        taken = np.zeros(self.d, dtype=np.int64)
        done, bar, goal = 0, -np.inf, FIRST
        while done < len(by):
            to = min(len(by), max(done, int(np.searchsorted(work, goal * work[-1]))) + 1)
            more = taken + np.bincount(dim[done:to], weights=length[done:to], minlength=self.d).astype(np.int64)
            for d in np.flatnonzero(more > taken):
                at = slice(self.n - more[d], self.n - taken[d]) if up[d] else slice(taken[d], more[d])
                np.add.at(score, self.post[d, at], self.value[d, at] * q[d] - base[d])
            self.taken += int((more - taken).sum())
            done, taken, goal = to, more, goal + LOOK
            after[:] = 0
            after[dim[done:][::-1]] = impact[done:][::-1]  # of the next segment of each dimension
            # the k-th exact score among the leaders so far is a lower bound of the k-th best
            some = min(self.n, 4 * k)
            leaders = np.argpartition(score, self.n - some)[self.n - some :]
            bar = max(bar, float(sorted(self._scores(leaders, q, whole))[-k]))
            first, last = (c.astype(self.place.dtype)[:, None] for c in (np.where(up, 0, taken), np.where(up, self.n - taken, self.n)))
            unseen = (self.place >= first) & (self.place < last)
            most = score + np.einsum("d,dn->n", after, unseen)
            possible = np.flatnonzero(most >= bar - margin - abs(bar) * (0.0 if whole else 2.0**-40))
            if len(possible) <= max(k, self.n * POSSIBLE):
                break
        out: list[tuple[int, int]] = []
        scores = self._scores(possible, q, whole)
        few = range(len(scores))
        if whole and len(scores) > k:  # only the k best and their ties
            held = np.array(scores)
            few = np.flatnonzero(held >= np.partition(held, len(held) - k)[len(held) - k]).tolist()
        for i in sorted(few, key=lambda i: -scores[i]):
            if len(out) >= self.k and scores[i] < out[self.k - 1][0]:
                break
            out += [(scores[i], int(self.ids[m])) for m in self.members[possible[i]] if self.rows[m] != own]
            out.sort(key=lambda t: (-t[0], t[1]))
            del out[self.k :]
        return out

    def _scores(self, which: np.ndarray, q: np.ndarray, whole: bool) -> list[int]:
        if whole:
            return (self.x[which] @ q).astype(np.int64).tolist()
        by = [int(v) for v in q]
        return [sum(int(a) * b for a, b in zip(row, by, strict=True)) for row in self.x[which]]


def quantise(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as double, kept as double; null if any is null or not finite."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(x, lambda v: _floor(v * F.lit(scale).cast("double"))))


def _floor(v: Column) -> Column:
    """Doubles of 2^52 and more are whole, and their floor need not fit a long."""
    return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)


def _packed(rows: pd.DataFrame) -> tuple[bytes, bytes, bytes]:
    return rows["row"].to_numpy("<i8").tobytes(), rows["vec_id"].to_numpy("<i8").tobytes(), np.concatenate(rows["q"].to_numpy()).astype("<f8").tobytes()


def _unpacked(row: bytes, vec_id: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(row, "<i8")
    return rows, np.frombuffer(vec_id, "<i8"), np.frombuffer(x, "<f8").reshape(len(rows), -1)


def _key(score: int) -> str:
    """Orders scores that do not fit a long among themselves; empty for all others."""
    return "" if -LONG < score < LONG else f"{score + 10**99:0100d}"


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors(vec_id, embedding) for each row where queries holds."""
    scratch = Scratch(vectors.sparkSession, "topk")
    with scratch:
        v = pick(vectors, vec_id="long", embedding="array<double>")
        v = v.select("vec_id", quantise(F.col("embedding"), scale).alias("q"), F.coalesce(queries, F.lit(False)).alias("asks")).where("q is not null and vec_id is not null")
        v = scratch.keep(v.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("q")}), "vectors")
        n, asking = v.agg(F.count("*"), F.count_if("asks")).first()
        blocks, parts = max(1, -(-n // block)), max(1, -(-asking // query_block))

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, *_packed(rows))])

        def deal(df: DataFrame, m: int, number: str, names: str) -> DataFrame:
            dealt = df.withColumn(number, F.pmod(F.xxhash64("row", F.lit(number)), F.lit(m)).cast("int"))
            return dealt.groupBy("dim", number).applyInPandas(pack, f"dim int, {number} int, {names}")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, index, best = None, None, {}

            def found() -> pa.RecordBatch:
                rows = [(*at, i, max(-LONG - 1, min(LONG, s)), _key(s)) for at, top in best.items() for s, i in top]
                best.clear()
                cols = list(zip(*rows, strict=True)) or [()] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["row", "query_id", "vec_id", "score", "key"])

            for b in batches:
                for dim, number, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (dim, number) != held:
                        held, index = (dim, number), Block(*_unpacked(*parts[:3]), k)
                    for row, vec_id, q in zip(*_unpacked(*parts[3:]), strict=True):
                        at = int(row), int(vec_id)
                        best[at] = sorted(best.get(at, []) + index.search(q, row), key=lambda t: (-t[0], t[1]))[:k]
                if len(best) >= HELD:
                    yield found()
            yield found()

        index = scratch.keep(deal(v.select("dim", "row", "vec_id", "q"), blocks, "block", "crow binary, cid binary, cx binary"), "blocks")
        asked = scratch.keep(deal(v.where("asks").select("dim", "row", "vec_id", "q"), parts, "part", "qrow binary, qid binary, qx binary"), "queries")
        # every batch meets every block: by hint, as Spark would broadcast or shuffle a copy of one side for each row of the other
        spark = vectors.sparkSession
        tasks = 4 * spark.sparkContext.defaultParallelism
        asked = asked.coalesce(max(1, -(-tasks // max(1, index.rdd.getNumPartitions())), -(-asking // HELD)))
        both = index.hint("shuffle_replicate_nl").join(asked, "dim").select("dim", "block", "crow", "cid", "cx", "qrow", "qid", "qx")
        with arrow_rows(spark, 4), setting(spark, "spark.sql.cartesianProductExec.buffer.in.memory.threshold", WAITING):  # a row holds a whole block
            best = scratch.keep(both.mapInArrow(tidy(meet), "row long, query_id long, vec_id long, score long, key string"), "best")
        rank = F.row_number().over(Window.partitionBy("row", "query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id"))
        return scratch.finish(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

"""N-gram Jaccard join: near-duplicate documents as components of exact links.

The document by n-gram incidence matrix is multiplied with its transpose in blocks of columns. Only columns that can
decide matter: with a common order of n-grams, two sets of at least the wanted similarity share an n-gram among the
first n - ceil(t * n) + 1 of each (prefixes). Prefix entries go to column blocks as packed arrays, and a block returns
the entries of n-grams that two or more sets hold. N-grams that very many documents share come last in the order; they
are counted over all documents, and a bounded list of them is broadcast. Being on the list changes only the order, never
the result. A column that is not listed holds less than half of a block's entries, or is so thinly spread that fewer
than COMMON_IN_BATCH of any HELD n-grams are its own.

Links then follow in two rounds. First every set meets the smallest set of each of its prefix n-grams (rows in
proportion to the entries, however large a group is), pairs that size or position bounds exclude are dropped, overlaps
are bounded by bitmaps of the whole sets (n-grams folded to twice as many columns as the set has, at least 1024): a
column that only one set has holds an n-gram that the other lacks. The pairs that remain are multiplied out: the overlap
of whole sets is accumulated block of columns by block, and a pair is dropped as soon as what is still to come cannot
reach the count that its sizes ask for. Components are formed of the links.

Then, in columns that still hold several components, the members outside the column's largest component meet the
members of other components; nothing meets within a component. A column is cut into cells of a bounded number of either
side, and a task multiplies its cells in arrays by sizes and positions. A cell with few pairs gives them out, at most FEW
for each of its members; where more are left, its members come again with their bitmaps, and only pairs that these leave
possible go out. So documents that merely share common passages cost comparisons, not rows. All pairs that went out are
bounded and multiplied out as above. So all links between components are found, and a group of thousands of near copies
costs a row each.

Defined results: words are split at the six white-space characters after lower-casing A-Z; with fewer words than n,
the whole sequence is the one shingle; null or empty texts have none and link with nothing; rows that share a doc_id
each get a row, and share a component if any of them is linked; a row without doc_id is in no component (null).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, U64, Scratch, finalise, hashed_texts, lazily, ngrams, pick, release, small, tidy
from quarry.llm.components import components

WORDS, PERCENT = 5, 75
#: An n-gram is listed as common if COMMON documents or more hold it, counted where COMMON_IN_BATCH or more of a stretch
#: of HELD n-grams do; at most MOST_COMMON are listed.
COMMON_IN_BATCH, COMMON, MOST_COMMON, HELD = 4, 64, 100_000, 2_000_000
#: Entries of one column block.
BLOCK = 500_000
#: Members of a column's cell on either side; rows of cells that a task holds at once; pairs that it multiplies at once.
CELL, CELLS, PAIRS = 4_096, 100_000, 200_000
#: Pairs for each member up to which a cell gives its pairs out before bitmaps are compared.
FEW = 2
#: Columns that are multiplied between two looks at the bound.
COLUMNS = 2_048
#: Rows of an Arrow batch of rows without texts or sets.
NARROW = 10_000


def shingle_set(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the n-grams of a text with these word hashes."""
    if not len(h):
        return np.zeros(0, dtype=U64)
    if len(h) < n:
        out = np.array([len(h)], dtype=U64)
        for x in h:
            out = finalise(out * U64(MIX) + x)
        return out
    out = np.sort(ngrams(h, n))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingle_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    return (shingle_set(h, n) for h in hashed_texts(texts, lower=True))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of the first so many n-grams of a set of n, any linked set shares one."""
    return n - -(-percent * n // 100) + 1


def summaries(documents: DataFrame, n: int = WORDS) -> DataFrame:
    """kind 0: doc_id, n (set size), key (128 bits of the set); kind 1: g, n: n-grams that several documents of a stretch of HELD n-grams hold."""

    names = ["kind", "doc_id", "n", "key", "g"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        g, c = np.unique(np.concatenate([*held, np.zeros(0, U64)]), return_counts=True)
        g, c = g[c >= COMMON_IN_BATCH].view(np.int64), c[c >= COMMON_IN_BATCH]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(g)), pa.int32()), pa.nulls(len(g), pa.int64()), pa.array(c.astype(np.int64)), pa.nulls(len(g), pa.binary()), pa.array(g)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys_held, size = [], set(), 0
        for b in batches:
            ns, keys = [], []
            for s in shingle_sets(lazily(b.column(1)), n):
                ns.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s) if len(s) else None)
                if len(s) and keys[-1] not in keys_held:  # equal sets count once
                    keys_held.add(keys[-1])
                    held.append(s)
                    size += len(s)
                if size >= HELD:
                    yield counted(held)
                    held, keys_held, size = [], set(), 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b)), pa.int32()), b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(b), pa.int64())], names=names)
        yield counted(held)

    return documents.mapInArrow(tidy(work), "kind int, doc_id long, n long, key binary, g long")


def prefix_entries(documents: DataFrame, common: np.ndarray, blocks: int, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Packed prefix entries by column block: block, and arrays g, doc_id, n, at (place in the set's order). Entries of
    listed n-grams, which are known to be shared, go in equal parts to blocks below 0 that only pass them on."""
    names = ["block", "g", "doc_id", "n", "at"]
    by = np.argsort(common)
    order, place = common[by], by + 1  # the list is rarer first

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, parts = set(), ([], [], [], [], [])
            b = b.filter(b.column(0).is_valid())
            b = b.take(pa.compute.sort_indices(b.column(0)))
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(lazily(b.column(1)), n), strict=True):
                if not len(s) or (key := s.tobytes() if len(s) < 4 else xxhash.xxh3_128_digest(s)) in seen:
                    continue  # the batch's smallest document stands for equal sets
                seen.add(key)
                want = prefix_length(len(s), percent)
                listed = np.zeros(len(s), dtype=np.int64)
                if len(order):
                    j = np.minimum(np.searchsorted(order, s), len(order) - 1)
                    hit = order[j] == s
                    listed[hit] = place[j[hit]]
                    if hit.any():
                        s = s[np.argsort(listed, kind="stable")]
                        listed.sort()
                for c, v in zip(parts, (s[:want], np.full(want, doc), np.full(want, len(s)), np.arange(want), listed[:want] > 0), strict=True):
                    c.append(v)
            if not parts[0]:
                continue
            g, doc, size, at, listed = map(np.concatenate, parts)
            block = (g % U64(blocks)).astype(np.int64)
            block = np.where(listed, -1 - doc % blocks, block)
            o = np.argsort(block, kind="stable")
            block, g, doc, size, at = block[o], g[o].view(np.int64), doc[o], size[o], at[o]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            step = np.diff(doc, prepend=0)  # differences take less room
            step[starts[:-1]] = doc[starts[:-1]]
            cut = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(block[starts[:-1]].astype(np.int32)), *(pa.ListArray.from_arrays(cut, pa.array(x.astype(t))) for x, t in ((g, np.int64), (step, np.int64), (size, np.int32), (at, np.int32)))], names=names)

    return documents.mapInArrow(tidy(work), "block int, g array<long>, doc_id array<long>, n array<int>, at array<int>")


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one column block: the entries of n-grams with two or more entries, each with the first document of its n-gram
    (null where the n-gram is a listed one, which other blocks hold too)."""
    release()  # of the block before
    g, n, at = (np.concatenate(rows[c].to_numpy()) for c in ("g", "n", "at"))
    doc = np.concatenate([np.cumsum(x) for x in rows["doc_id"]])
    if rows["block"].iloc[0] < 0:
        return pd.DataFrame({"g": g, "doc_id": doc, "n": n, "at": at, "a": pd.array([None] * len(g), "Int64"), "na": pd.array([None] * len(g), "Int64"), "ia": pd.array([None] * len(g), "Int64")})
    by = np.lexsort((doc, g))
    g, doc, n, at = g[by], doc[by], n[by], at[by]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(g)))
    first = np.repeat(head, size)
    keep = np.repeat(size > 1, size)
    out = {"g": g, "doc_id": doc, "n": n, "at": at, "a": doc[first], "na": n[first], "ia": at[first]}
    return pd.DataFrame({k: v[keep] for k, v in out.items()})


def bitmap(s: np.ndarray) -> bytes:
    """Which columns a set's n-grams fall into when they are folded to 1024 or, for larger sets, 4096, 16384 and so on."""
    m = 1024
    while m < 2 * len(s):
        m *= 4
    bits = np.zeros(m, dtype=bool)
    bits[(s >> U64(20)).astype(np.int64) & (m - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes], columns: int) -> np.ndarray:
    """Bitmaps folded to so many columns, a row of 64-bit words each; those that have fewer are left empty."""
    out = np.zeros((len(maps), columns // 64), dtype=U64)
    for k, m in enumerate(maps):
        if len(m) * 8 >= columns:
            out[k] = np.bitwise_or.reduce(np.frombuffer(m, U64).reshape(-1, columns // 64), axis=0)
    return out


def _enough(na: np.ndarray, nb: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    return 100 * most >= percent * (na + nb - most)


def _most_shared(maps: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """At least the overlap: a column that only one of two sets has holds an n-gram that the other lacks."""
    x, y = maps[a], maps[b]
    only = lambda u, v: np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64)
    return np.minimum(n[a] - only(x, y), n[b] - only(y, x))


def possible(maps: list[bytes], a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of sets the finest folded columns that both have leave possible, coarse ones first."""
    held = np.array([len(m) * 8 for m in maps], dtype=np.int64)
    ok, columns = np.ones(len(a), dtype=bool), 1024
    while len(rows := np.flatnonzero(ok & (np.minimum(held[a], held[b]) >= columns))):
        for part in np.array_split(rows, len(rows) * columns // (1 << 26) + 1):
            here = np.unique(np.concatenate((a[part], b[part])))
            x, y = np.searchsorted(here, a[part]), np.searchsorted(here, b[part])
            ok[part] = _enough(n[a[part]], n[b[part]], _most_shared(folded([maps[r] for r in here], columns), x, y, n[here]), percent)
        columns *= 4
    return ok


def _closer(pairs: DataFrame, documents: DataFrame, scratch: Scratch, name: str, n: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those that bitmaps of folded columns leave possible."""
    pairs = scratch.keep(pairs, f"{name}-candidates")
    ids = scratch.keep(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id")), f"{name}-ids")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [(len(s), bitmap(s)) for s in shingle_sets(lazily(b.column(1)), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in seen], pa.int64()), pa.array([p for _, p in seen], pa.binary())], names=["doc_id", "n", "map"])

    known = documents.where("text is not null").join(small(ids), "doc_id", "left_semi").mapInArrow(tidy(describe), "doc_id long, n long, map binary")
    known = scratch.keep(known, f"{name}-maps")
    side = lambda x: known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"p{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.concatenate((b.column(2).to_numpy(), b.column(3).to_numpy()))
            at = np.arange(len(b))
            keep = pa.array(possible(b.column(4).to_pylist() + b.column(5).to_pylist(), at, at + len(b), sizes, percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "pa", "pb")
    return both.mapInArrow(tidy(work), "a long, b long")


def overlap(a: np.ndarray, b: np.ndarray, least: int, columns: int = COLUMNS) -> int:
    """The number of n-grams that two sorted sets share, accumulated block by block of columns; -1 as soon as it is
    certain to be below least."""
    blocks = max(1, (len(a) + len(b)) // columns)
    edges = np.array([k * (1 << 64) // blocks for k in range(1, blocks)], dtype=U64)
    ends = [np.concatenate((np.searchsorted(x, edges), [len(x)])) for x in (a, b)]
    got, at = 0, (0, 0)
    for to in zip(*ends, strict=True):
        got += len(np.intersect1d(a[at[0] : to[0]], b[at[1] : to[1]], assume_unique=True))
        at = to
        if got + min(len(a) - at[0], len(b) - at[1]) < least:
            return -1
    return got


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    yield from np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _links(pairs: DataFrame, documents: DataFrame, scratch: Scratch, name: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    wanted = scratch.keep(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id")), f"{name}-wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in shingle_sets(lazily(b.column(1)), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "grams"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(_lists(b.column(2)), _lists(b.column(3)), strict=True):
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                linked.append(overlap(x.view(U64), y.view(U64), least) >= least)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    sets = scratch.keep(documents.where("text is not null").join(small(wanted), "doc_id", "left_semi").mapInArrow(tidy(work), "doc_id long, grams array<long>"), f"{name}-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb")
    out = scratch.keep(both.mapInArrow(tidy(multiply), "a long, b long"), f"{name}-links", 32)
    scratch.remove(f"{name}-sets")
    return out


def cells_of(rows: pd.DataFrame) -> np.ndarray:
    """The number of the cell of each row of a frame sorted by cell."""
    new = np.ones(len(rows), dtype=bool)
    for c in ("g", "i", "j"):
        v = rows[c].to_numpy()
        new[1:] &= v[1:] == v[:-1]
    new[1:] = ~new[1:]
    return np.cumsum(new) - 1


def product(cells: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of cells(g, i, j, probe, doc_id, n, at, root, main and, if known, map), sorted by g, i, j, probe: index pairs of a
    probe and another member of its cell that are in different components and that no bound excludes."""
    doc, n, at, root, main = (cells[c].to_numpy() for c in ("doc_id", "n", "at", "root", "main"))
    n, at = n.astype(np.int64), at.astype(np.int64)
    probe = cells["probe"].to_numpy(dtype=bool)
    cell = cells_of(cells)
    members = np.bincount(cell[~probe], minlength=cell[-1] + 1)  # within a cell, members come before probes
    begin = np.searchsorted(cell, np.arange(cell[-1] + 1))
    probes = np.flatnonzero(probe)
    todo = members[cell[probes]]
    maps = cells["map"].tolist() if "map" in cells else None
    run = np.cumsum(todo)
    at_probe = 0
    while at_probe < len(probes):
        done = run[at_probe - 1] if at_probe else 0
        to = max(at_probe + 1, int(np.searchsorted(run, done + PAIRS, side="right")))
        some, k = probes[at_probe:to], todo[at_probe:to]
        at_probe = to
        a = np.repeat(some, k)
        b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[cell[some]], k)
        # two probes meet once, from the smaller document
        keep = (root[a] != root[b]) & ((root[b] == main[b]) | (doc[a] < doc[b]))
        a, b = a[keep], b[keep]
        keep = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[keep], b[keep]
        keep = _enough(n[a], n[b], np.minimum(n[a] - at[a], n[b] - at[b]), percent)
        a, b = a[keep], b[keep]
        if maps:
            keep = possible(maps, a, b, n, percent)
            a, b = a[keep], b[keep]
        yield a, b


def _possible(percent: int) -> str:
    """By size, and by place: what is still to come of either set after its first common n-gram bounds the overlap."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and 100 * least(na - ia, nb - ib) >= {percent} * (na + nb - least(na - ia, nb - ib))"


CELL_ROWS = "bin int, g long, i int, j int, probe boolean, doc_id long, n int, at int, root long, main long"


def _meetings(e: DataFrame, documents: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of entries e(g, doc_id, n, at, root) of one column and different components that no bound excludes."""
    per = e.groupBy("g", "root").agg(F.count("*").alias("m"))
    per = per.groupBy("g").agg(F.max(F.struct("m", "root")).alias("main"), F.count("*").alias("k"), F.sum("m").alias("m")).where("k > 1")
    cells = lambda m: F.ceil(m / CELL).cast("int")
    open_ = per.select("g", F.col("main.root").alias("main"), F.col("m"), (F.col("m") - F.col("main.m")).alias("p"), cells(F.col("m") - F.col("main.m")).alias("ci"), cells(F.col("m")).alias("cj"))
    open_ = scratch.keep(open_, "open", NARROW)
    size = open_.agg(F.coalesce(F.sum(F.col("m") * F.col("ci") + F.col("p") * F.col("cj")), F.lit(0))).first()[0]
    e = scratch.keep(e.join(open_.drop("m", "p"), "g"), "rooted", NARROW)
    deal = lambda m, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    probes = e.where("root <> main").withColumns({"i": deal("ci", 1), "probe": F.lit(True)}).withColumn("j", every("cj"))
    others = e.withColumns({"j": deal("cj", 2), "probe": F.lit(False)}).withColumn("i", every("ci"))
    rows = probes.select("g", "i", "j", "probe", "doc_id", "n", "at", "root", "main").unionByName(others.select("g", "i", "j", "probe", "doc_id", "n", "at", "root", "main"))
    bins = int(size // CELLS) * 2 + 12
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("g", "i", "j"), F.lit(bins)).cast("int"))
    order = ["g", "i", "j", "probe"]

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        """Of cells with few pairs that sizes and places leave: the pairs; of the others: the members in such pairs."""
        release()  # of the bin before
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        cell, doc = cells_of(rows), rows["doc_id"].to_numpy()
        room = FEW * np.bincount(cell)
        found, hit, out = np.zeros(len(room), dtype=np.int64), np.zeros(len(rows), dtype=bool), [np.zeros((3, 0), dtype=np.int64)]
        for a, b in product(rows, percent):
            hit[a], hit[b] = True, True
            found += np.bincount(cell[a], minlength=len(room))
            few = found[cell[a]] <= room[cell[a]]
            a, b = a[few], b[few]
            out.append(np.stack((cell[a], np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]))))
        pairs = np.concatenate(out, axis=1)
        pairs = np.unique(pairs[1:, (found <= room)[pairs[0]]], axis=1)
        many = rows[hit & (found > room)[cell]]
        one = pd.DataFrame({c: pd.array([None] * pairs.shape[1], "Int64") for c in rows.columns} | {"doc_id": pairs[0], "other": pairs[1], "probe": False})
        return pd.concat([many.assign(other=pd.array([None] * len(many), "Int64")), one])[[*rows.columns, "other"]]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [bitmap(s) for s in shingle_sets(lazily(b.column(1)), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(maps, pa.binary())], names=["doc_id", "n", "map"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        release()  # of the bin before
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        doc, out = rows["doc_id"].to_numpy(), [np.zeros((2, 0), dtype=np.int64)]
        for a, b in product(rows, percent):
            out.append(np.unique(np.stack((np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]))), axis=1))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pd.DataFrame({"a": a, "b": b})

    marked = scratch.keep(rows.groupBy("bin").applyInPandas(mark, CELL_ROWS + ", other long"), "marked", NARROW)
    few = marked.where("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    many = marked.where("other is null").drop("other")
    ids = scratch.keep(many.select("doc_id", "n").distinct(), "marked-ids", NARROW)
    # rows of one doc_id with different texts have a map each, told apart by size
    sized = documents.where("text is not null").join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi").join(ids, "doc_id").select("doc_id", "text", "n")
    maps = scratch.keep(sized.mapInArrow(tidy(describe), "doc_id long, n int, map binary").distinct(), "maps")
    met = many.join(maps, ["doc_id", "n"]).groupBy("bin").applyInPandas(meet, "a long, b long")
    return few.unionByName(met).distinct()


def near_duplicates(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents."""
    with Scratch(documents.sparkSession, "jaccard") as scratch:
        return scratch.finish(_components(pick(documents, doc_id="long", text="string"), scratch, n, percent))


def _components(d: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    both = scratch.keep(summaries(d, n), "summaries")
    docs = both.where("kind = 0").select("doc_id", "n", "key")
    total = docs.agg(F.coalesce(F.sum((100 - percent) * F.col("n") / 100 + 1), F.lit(0))).first()[0]
    blocks = int(total // BLOCK) * 2 + 12
    # no more than 2 * blocks columns can fill half of a block
    listed = both.where("kind = 1").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "g").limit(max(MOST_COMMON, 2 * blocks))
    common = np.array([r.g for r in listed.collect()][::-1], dtype=np.int64).view(U64)  # rarer first
    # the smallest document stands for all of equal sets; it has all their entries itself
    least = scratch.keep(docs.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "least")
    copies = scratch.keep(docs.join(least.where("rep < top").select("key", "rep"), "key").where("doc_id > rep").select("doc_id", "rep").distinct(), "copies")

    packed = prefix_entries(d, common, blocks, n, percent)
    entries = packed.groupBy("block").applyInPandas(_shared, "g long, doc_id long, n int, at int, a long, na int, ia int")
    # a doc_id that stands for a set in another of its rows keeps its entries, as they are not told apart by set
    only_copies = scratch.keep(copies.select("doc_id").distinct().join(least.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "only_copies")
    entries = scratch.keep(entries.join(small(only_copies), "doc_id", "left_anti"), "entries")

    e = entries.select("g", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "a", "na", "ia")
    known = e.where("a is null").drop("a", "na", "ia")
    head = scratch.keep(known.groupBy("g").agg(F.min(F.struct("b", "nb", "ib")).alias("x"), F.max("b").alias("top")).where("x.b < top").select("g", F.col("x.b").alias("a"), F.col("x.nb").alias("na"), F.col("x.ib").alias("ia")), "heads")
    stars = e.where("a is not null").unionByName(known.join(head, "g")).where("a < b").where(_possible(percent)).select("a", "b").distinct()
    links = _links(_closer(stars, d, scratch, "stars", n, percent), d, scratch, "stars", n, percent)
    roots = components(links, scratch, "first")

    # columns that still hold several components
    roots = roots.select(F.col("node").alias("doc_id"), "root")
    e = entries.select("g", "doc_id", "n", "at").join(small(roots), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    more = _links(_closer(_meetings(e, d, scratch, n, percent), d, scratch, "rest", n, percent), d, scratch, "rest", n, percent)
    pairs = links.unionByName(more).unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    roots = components(pairs, scratch, "last")
    return docs.join(roots, docs.doc_id == roots.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))

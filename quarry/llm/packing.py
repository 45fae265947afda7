"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt into shards of a bounded number. Within a shard only the counts of lengths matter, as pieces of one
length are interchangeable, so an individual is a list of bins of lengths. Several islands evolve a shard from different
starts, then pass their elite on to the next island of the ring and evolve again. Crossover injects whole well-filled
bins of one parent into the other and removes the bins that now hold too many of a length. Displaced lengths first take
the place of one or two shorter ones in bins that they fill better, and what is left goes in by best fit, longest first.
Whole packings of a shard meet once per migration; between migrations a population evolves the part of the shard that
matters, the bins with room together with full ones to exchange with, so that a generation costs little. The worst of a
population gives way to a better child of two tournament winners; fitness is the number of bins, then the sum of the
squares of their fill. Pieces as long as the capacity are sequences of their own. An island stops at once when it meets
a lower bound of its shard, which proves it best.

Defined results: a null text is empty, one sequence end; repeated rows are packed each; runs of one character of any
length get the ids of the plain tokenizer; an empty table packs nothing.
"""

from __future__ import annotations

import base64
import json
import random
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, lazily, partitions, pick, release, tidy

CAPACITY, END = 1024, 2
SHARD, ISLANDS, ROUNDS = 20_000, 3, 2
#: Of the bins with room, so many evolve at a time, with twice as many full ones and SPARE.
KERNEL, SPARE = 200, 64
#: The fast encoder recurses over white space; texts with a run of so many go to the plain one.
LONG_SPACE = re.compile(r"\s{10000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=4)
def encoder(path: str | None = None, ranks: str | None = None):
    """text -> ids of the vocabulary at path, special strings as ordinary text. Texts of Latin characters go through
    the ranks of the same vocabulary, which give the same ids several times as fast; all others, and texts with very
    long runs of white space, on which that encoder fails, through path itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    if path and not ranks:
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    usual = lambda text: (text.isascii() or max(text) < "ɐ") and (len(text) < 10_000 or not LONG_SPACE.search(text))
    return lambda text: fast.encode_ordinary(text) if usual(text) else whole.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def document_encoder(path: str | None = None, ranks: str | None = None):
    """text -> ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them: an added token's
    string becomes its id. Texts that hold none go through encoder."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    if path and not ranks:
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    ordinary = encoder(path, ranks)
    return lambda text: whole.encode(text, add_special_tokens=False).ids if any(x in text for x in added) else ordinary(text)


def tokenise(documents: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """PIECES of every document: its ids and an end id; longer ones are cut into pieces of capacity, the first shorter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(path, ranks)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), lazily(b.column(1)), strict=True):
                ids = array("I", encode(text) if text else ())
                ids.append(end)
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(cols, (doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes())), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(documents, doc_id="long", text="string").mapInArrow(tidy(work), PIECES)


class Bins:
    """Open bins by free room, so that best fit is one look at a bit mask."""

    def __init__(self, capacity: int, bins: list[list[int]] = ()):
        self.capacity, self.bins, self.free, self.mask = capacity, [], defaultdict(list), 0
        for b in bins:
            self.bins.append(list(b))
            self._offer(len(self.bins) - 1, capacity - sum(b))

    def _offer(self, k: int, room: int) -> None:
        if room:
            self.free[room].append(k)
            self.mask |= 1 << room

    def put(self, length: int) -> None:
        """Into the fullest bin that has room, else a new one."""
        x = self.mask >> length
        if x:
            room = length + (x & -x).bit_length() - 1
            k = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
            self.bins[k].append(length)
            self._offer(k, room - length)
        else:
            self.bins.append([length])
            self._offer(len(self.bins) - 1, self.capacity - length)


def best_fit(lengths: list[int], capacity: int, bins: list[list[int]] = ()) -> list[list[int]]:
    out = Bins(capacity, bins)
    for x in lengths:
        out.put(x)
    return out.bins


def exact_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Longest first; each is joined by the longest one or two others that fill its bin, else by best fit at the end."""
    n = [0] * (capacity + 1)
    for x, k in counts.items():
        n[x] = k
    bins = []
    for a in range(capacity, 0, -1):
        while n[a]:
            n[a] -= 1
            room, bin_ = capacity - a, [a]
            x = min(room, a)
            if room and room <= a and n[room]:
                bin_.append(room)
            else:
                while 2 * x >= room > 0:
                    y = room - x
                    if n[x] and y and n[y] and (x != y or n[x] > 1):
                        bin_ += [x, y]
                        break
                    x -= 1
                else:
                    # no exact fill: the longest partner that fits, as best fit would
                    x = next((x for x in range(min(room, a), 0, -1) if n[x]), 0)
                    bin_ += [x] * bool(x)
            for x in bin_[1:]:
                n[x] -= 1
            bins.append(bin_)
    if not bins:
        return bins
    last = [b for b in bins if sum(b) < capacity // 2]  # what is left at the end is packed anew
    return best_fit(sorted((x for b in last for x in b), reverse=True), capacity, [b for b in bins if sum(b) >= capacity // 2])


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound. For every threshold a up to half the capacity: lengths over capacity - a share with none from a
    on, those over half not with each other, and what they leave open must do for the rest (Martello and Toth's L2)."""
    n = [0] * (capacity + 2)
    for x, k in counts.items():
        n[x] = k
    best = -(-sum(x * k for x, k in counts.items()) // capacity)
    half = capacity // 2
    single, pair, pair_sum = 0, sum(n[half + 1 :]), sum(x * n[x] for x in range(half + 1, capacity + 1))
    small = sum(x * n[x] for x in range(1, half + 1))
    for a in range(1, half + 1):
        x = capacity - a + 1  # longer than capacity - a from now on
        if x > half:
            single, pair, pair_sum = single + n[x], pair - n[x], pair_sum - x * n[x]
        best = max(best, single + pair + max(0, -(-(small - (pair * capacity - pair_sum)) // capacity)))
        small -= a * n[a]
    return best


def fitness(bins: list[list[int]]) -> tuple[int, int]:
    """Lower is better: bins, then less the sum of their squared fill (well-filled bins beside poor ones are better)."""
    return len(bins), -sum(sum(b) ** 2 for b in bins)


def refill(bins: list[list[int]], displaced: list[int], capacity: int) -> list[int]:
    """Displaced lengths take the place of one or two shorter ones in bins that they fill better. What is displaced now."""
    out = sorted(displaced)
    for bin_ in bins:
        room = capacity - sum(bin_)
        if not room or not out:
            continue
        n = len(bin_)
        gain, leave, at = 0, None, -1
        for away in [(i,) for i in range(n)] + [(i, k) for i in range(n) for k in range(i)]:
            held = sum(bin_[i] for i in away)
            j = bisect_right(out, held + room) - 1
            if j >= 0 and out[j] - held > gain:
                gain, leave, at = out[j] - held, away, j
        if leave:
            comes, goes = out.pop(at), [bin_[i] for i in leave]
            bin_[:] = [x for i, x in enumerate(bin_) if i not in leave] + [comes]
            for x in goes:
                insort(out, x)
    return out


def crossover(a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """b's well-filled bins go whole into a; a's bins that hold too many of a length go; what they held is placed anew."""
    good = sorted(b, key=lambda x: -sum(x) + 0.02 * capacity * rng.random())[: max(1, 3 * len(b) // 4)]
    inject = rng.sample(good, min(len(good), rng.randint(1, max(1, len(b) // 2)))) if good else []
    left = Counter(x for bin_ in a for x in bin_)
    left.subtract(x for bin_ in inject for x in bin_)
    kept, order, opened = [], list(a), 0.3 * rng.random()
    rng.shuffle(order)
    order.sort(key=lambda x: -sum(x))
    for bin_ in order:
        if sum(bin_) < capacity and rng.random() < opened:
            continue  # bins with room are opened now and then
        need = Counter(bin_)
        if all(left[x] >= n for x, n in need.items()):
            left.subtract(need)
            kept.append(list(bin_))
    displaced = refill(kept, list((+left).elements()), capacity)
    return best_fit(sorted(displaced, reverse=True), capacity, [*inject, *kept])


def generations_of(own: list[list[int]], capacity: int, rng: random.Random, generations: int, size: int) -> list[list[int]]:
    """The best packing of own's lengths after so many generations for each bin above the lower bound, at most 8 of them.
    The population starts from own and from best fit in orders of different disorder."""
    lengths = [x for b in own for x in b]
    bound = least_bins(Counter(lengths), capacity)
    people = [own]
    while len(people) < size:
        disorder = rng.uniform(0.05, 0.9)
        people.append(best_fit(sorted(lengths, key=lambda x: -x * rng.uniform(1 - disorder, 1.0)), capacity))
    fit = [fitness(p) for p in people]
    win = lambda: min(rng.randrange(size), rng.randrange(size), key=lambda k: fit[k])
    for _ in range(generations * min(8, max(0, min(fit)[0] - bound))):
        best = min(fit)
        if best[0] <= bound:
            break
        i, j = win(), win()
        child = crossover(people[i], people[j], capacity, rng)
        new, worst = fitness(child), max(range(size), key=lambda k: fit[k])
        if new < fit[worst] and new not in fit:
            people[worst], fit[worst] = child, new
    return people[min(range(size), key=lambda k: fit[k])]


def start(counts: dict[int, int], capacity: int, seed: int) -> list[list[int]]:
    """An island's first packing: best fit by length, exact fills, or best fit in a slightly disordered order."""
    if seed % ISLANDS == 1:
        return exact_fit(counts, capacity)
    lengths, rng = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True), random.Random(seed)
    return best_fit(lengths if seed % ISLANDS == 0 else sorted(lengths, key=lambda x: -x * rng.uniform(0.9, 1.0)), capacity)


def evolve(counts: dict[int, int], elites: list[list[list[int]]], capacity: int, seed: int, epochs: int = 6, generations: int = 20, size: int = 8) -> list[list[int]]:
    """The best packing an island finds, from its elites or, without them, from its start. Elites that meet here are
    crossed as wholes; then the open bins evolve in epochs, and two without gain end the search."""
    rng = random.Random(seed)
    bound = least_bins(counts, capacity)
    people = sorted(elites or [start(counts, capacity, seed)], key=fitness)
    best, idle = people[0], 0
    for other in people[1:]:
        for _ in range(2):
            best = min(best, crossover(best, other, capacity, rng), crossover(other, best, capacity, rng), key=fitness)
    for _ in range(epochs):
        if len(best) <= bound or idle >= 2:
            break
        open_, full = [b for b in best if sum(b) < capacity], [b for b in best if sum(b) == capacity]
        rng.shuffle(open_)
        rng.shuffle(full)
        open_.sort(key=lambda b: sum(b) + idle * capacity * rng.random())  # after no gain, others than the emptiest
        n = min(len(open_), KERNEL)
        m = min(len(full), 2 * n + SPARE)
        own = open_[:n] + full[:m]
        found = generations_of(own, capacity, rng, generations, size)
        idle = 0 if len(found) < len(own) else idle + 1
        best = min(best, open_[n:] + full[m:] + found, key=fitness)
    return best


def _pack(bins: list[list[int]]) -> str:
    """Equal bins once, with their number."""
    return json.dumps([[n, *b] for b, n in Counter(tuple(sorted(b, reverse=True)) for b in bins).items()])


def _unpack(text: str) -> list[list[int]]:
    return [b for n, *b in json.loads(text) for _ in range(n)]


def pack_sequences(documents: DataFrame, capacity: int = CAPACITY, end: int = END, shard: int = SHARD, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """PIECES with sequence_id and offset: the place of every piece of every document."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(tokenise(documents, capacity, end, path, ranks).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    counts = pieces.where(F.col("length") < capacity).groupBy("shard", "length").agg(F.count("*").alias("n"))
    counts = scratch.keep(counts.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("counts")), "counts")
    islands = counts.select("shard", "counts", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    n = min(max(partitions(spark), 1), shards * ISLANDS)
    elites = None
    for round_ in range(ROUNDS):
        given = islands.withColumn("elites", F.array().cast("array<string>")) if elites is None else islands.join(elites, ["shard", "island"])

        def island(batches: Iterator[pd.DataFrame], round_: int = round_) -> Iterator[pd.DataFrame]:
            for df in batches:
                best = [_pack(evolve(dict(c), [_unpack(x) for x in e], capacity, 1_000_003 * round_ + ISLANDS * int(s) + int(i))) for s, i, c, e in zip(df["shard"], df["island"], df["counts"], df["elites"], strict=True)]
                yield pd.DataFrame({"shard": df["shard"], "island": df["island"], "best": best})

        found = given.repartition(n, "shard", "island").mapInPandas(tidy(island), "shard long, island int, best string")
        found = scratch.keep(found, f"round{round_}")
        # an island's elite stays and goes to the next of the ring
        moved = found.select("shard", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).alias("island"), "best")
        elites = scratch.keep(moved.groupBy("shard", "island").agg(F.collect_set("best").alias("elites")), f"elites{round_}")
    n_bins = F.aggregate(F.from_json("best", "array<array<int>>"), F.lit(0).cast("long"), lambda a, b: a + b[0])
    best = found.groupBy("shard").agg(F.min_by("best", F.struct(n_bins, "island")).alias("best"))

    def place(key: tuple, items: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        release()  # of the shard before
        items = items.sort_values(["length", "doc_id", "piece", "row"])
        queue = {k: list(v) for k, v in items.groupby("length").indices.items()}
        where, offset = [0] * len(items), [0] * len(items)
        bins = _unpack(plan["best"].iloc[0]) if len(plan) else []
        for k, bin_ in enumerate(bins + [[capacity]] * len(queue.get(capacity, ()))):
            at = 0
            for x in bin_:
                i = queue[x].pop()
                where[i], offset[i] = (int(key[0]) << 32) + k, at
                at += x
        items["doc_id"] = items["doc_id"].astype("Int64")
        return items.assign(sequence_id=where, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    placed = pieces.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, PIECES + ", sequence_id long, offset long")
    return scratch.finish(placed)

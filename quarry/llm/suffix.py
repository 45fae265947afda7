"""Suffix-array dedup on sparse suffixes: passages of at least min_words words that occur earlier in the corpus.

A suffix is retained where a run of ANCHOR words has the least fingerprint of a window (a minimiser), so that any two
equal runs of min_words words retain a suffix at the same place. Retained suffixes are sorted, by the fingerprint of
their first ANCHOR words, then document and place, and each is compared with its neighbours in that order: those without
an equal neighbour end here, which is most of a clean corpus. The others are sorted again by their first min_words
words. A match between retained suffixes of the same two texts at one distance needs no more work. Everywhere else
matches are extended left and right, word by word: all runs of min_words words around a shared anchor are sorted and
compared with their neighbours in the same way. Matches that continue each other are joined, and every joined passage is
verified before it counts: digests of its whole words (BLAKE2b, 128 bits) are made in both documents from the texts and
compared. A word is repeated if it lies in a run of min_words words that has an earlier occurrence, by (doc_id, place).
This is what comparing all runs of all texts would give; 64-bit fingerprints of different runs that happen to be equal
cannot make a repeat, only hide one behind an earlier run that they wrongly equal.

Sorting is by ranges of (fingerprint, doc_id, place), which split a passage that very many documents share as they split
anything else; a task compares the rows of its range as they pass, and groups that cross ranges are settled by one
summary row for either end of each range, which is what the driver sees of a sort.

Defined results: words are split at the six white-space characters and compared as they are; null, empty or shorter
texts have no repeats; a row without doc_id takes no part and is kept as it is; equal rows are one occurrence; rows
with one doc_id but different texts share their spans, which end with the text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_IDS, Scratch, encode, hashed_texts, lazily, long_ngrams, partitions, pick, small, tidy

MIN_WORDS, ANCHOR = 50, 16
#: Rows of one range of a sort; and of an Arrow batch of rows without texts.
RANGE, NARROW = 4_000_000, 10_000
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprints(hashes: np.ndarray, min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of anchor words, and of every run of min_words words."""
    return long_ngrams(hashes, anchor), long_ngrams(hashes, min_words)


def sliding(x: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every window, by doubling."""
    n, w = len(x) - window + 1, 1
    while 2 * w <= window:
        x = best(x[: len(x) - w], x[w:])
        w *= 2
    return best(x[:n], x[window - w : window - w + n])


def minimisers(fp: np.ndarray, window: int) -> np.ndarray:
    """Places of the least fingerprint (all of equals) of every window of so many runs."""
    if len(fp) < window:
        return np.zeros(0, dtype=np.int64)
    least = np.pad(sliding(fp, window, np.minimum), window - 1)
    return np.flatnonzero(fp == sliding(least, window, np.maximum))


def _texts(documents: DataFrame) -> DataFrame:
    return pick(documents, doc_id="long", text="string").where("doc_id is not null and text is not null")


def retained(texts: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """head (of the first anchor words), body (of the first min_words words; null near the end), doc_id, at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: tuple[list, ...] = ([], [], [], [])
            for h in hashed_texts(lazily(b.column(1))):
                short, long = fingerprints(h, min_words, anchor)
                at = minimisers(short, min_words - anchor + 1)
                body = np.zeros(len(at), dtype=np.uint64)
                has = at < len(long)
                body[has] = long[at[has]]
                for c, v in zip(parts, (short[at], body, has, at), strict=True):
                    c.append(v)
            n = [len(x) for x in parts[3]]
            head, body, has, at = (np.concatenate([*c, np.zeros(0, t)]) for c, t in zip(parts, (np.uint64, np.uint64, bool, np.int64), strict=True))
            docs = np.repeat(np.array(b.column(0).to_pylist(), dtype=np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(body.view(np.int64), mask=~has.astype(bool)), pa.array(docs), pa.array(at.astype(np.int32))], names=["head", "body", "doc_id", "at"])

    return texts.mapInArrow(tidy(work), "head long, body long, doc_id long, at int")


PASSED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("extra", pa.int64()), ("first_doc", pa.int64()), ("first_at", pa.int32()), ("size", pa.int64())])
ROW, EDGE, SUMMARY = 0, 1, 2


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted range of (key, doc_id, at, extra): a ROW for every place whose key has another place, with the first
    of them. Whether the first and the last key go on in other ranges is not known here: places of the first key, and a
    single place of the last, come out as EDGE, and each of the two keys with its first place and number as SUMMARY."""
    seen, key, head, size, waiting, last = 0, None, (0, 0), 0, None, None
    first = None  # key, head and size of the range's first group

    def rows(kind, key, doc, at, extra, first_doc, first_at) -> pa.RecordBatch:
        n = len(doc)
        cols = [pa.array(np.broadcast_to(kind, n)), pa.array(key), pa.array(doc), pa.array(at), extra, pa.array(first_doc), pa.array(first_at), pa.nulls(n)]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, PASSED.types, strict=True)], schema=PASSED)

    for b in batches:
        k, d, a = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = b.column(3)
        if not len(k):
            continue
        before = last or (k[0], d[0], a[0] - 1)  # no place repeats one that is not there
        again = np.ones(len(k), dtype=bool)
        for c, v in zip((k, d, a), before, strict=True):
            again &= c == np.concatenate(([v], c[:-1]))
        if again.any():  # equal rows are one occurrence
            k, d, a, x = k[~again], d[~again], a[~again], x.filter(pa.array(~again))
            if not len(k):
                continue
        new = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        starts, group = np.flatnonzero(new), np.cumsum(new)
        sizes = np.bincount(group, minlength=len(starts) + 1)
        head_doc, head_at = np.concatenate(([head[0]], d[starts])), np.concatenate(([head[1]], a[starts]))
        if waiting is not None:
            if sizes[0]:
                yield rows(ROW, *waiting)
            waiting = None
        edge = seen + group == 1
        keep = edge | ~new | (sizes[group] > 1)
        if not edge[-1] and new[-1]:  # a single place so far: what follows decides
            waiting = (k[-1:], d[-1:], a[-1:], x.slice(len(k) - 1), d[-1:], a[-1:])
            keep[-1] = False
        if seen == 0:
            first = [int(k[0]), (int(d[0]), int(a[0])), 0]
        first[2] += int(edge.sum())
        if keep.any():
            yield rows(np.where(edge, EDGE, ROW)[keep], k[keep], d[keep], a[keep], x.filter(pa.array(keep)), head_doc[group][keep], head_at[group][keep])
        size = int(sizes[-1]) + (size if len(starts) == 0 else 0)
        seen, key, head, last = seen + len(starts), k[-1], (head_doc[-1], head_at[-1]), (k[-1], d[-1], a[-1])
    if first is None:
        return
    if waiting is not None:
        yield rows(EDGE, *waiting)
    ends = [first] + ([[int(key), (int(head[0]), int(head[1])), size]] if seen > 1 else [])
    yield pa.RecordBatch.from_pylist([{"kind": SUMMARY, "key": k, "doc_id": h[0], "at": h[1], "size": n} for k, h, n in ends], schema=PASSED)


def neighbours(rows: DataFrame, key: str, scratch: Scratch, name: str, extra: str | None = None) -> DataFrame:
    """doc_id, at, extra, first_doc, first_at of every place whose key has another place; first is the least of them.
    rows is a kept table."""
    n = max(partitions(scratch.spark), -(-rows.count() // RANGE))
    r = rows.select(F.col(key).alias("key"), "doc_id", "at", (F.col(extra) if extra else F.lit(None)).cast("long").alias("extra"))
    by = ["key", "doc_id", "at"]
    passed = r.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(tidy(compare), "kind int, key long, doc_id long, at int, extra long, first_doc long, first_at int, size long")
    passed = scratch.keep(passed, name, NARROW)
    # at most two keys of each range, of which the driver finds those that have several places
    ends: dict[int, tuple[int, int, int]] = {}
    for r in passed.where(F.col("kind") == SUMMARY).select("key", "doc_id", "at", "size").collect():
        doc, at, size = ends.get(r["key"], (r["doc_id"], r["at"], 0))
        ends[r["key"]] = (*min((doc, at), (r["doc_id"], r["at"])), size + r["size"])
    shared = sorted((k, doc, at) for k, (doc, at, size) in ends.items() if size > 1)
    keys, docs, ats = (np.array(c, dtype=np.int64) for c in (zip(*shared, strict=True) if shared else ((), (), ())))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edge = b.column(0).to_numpy() == EDGE
            key, first_doc, first_at = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (1, 5, 6))
            keep = ~edge
            if len(keys) and edge.any():
                at = np.flatnonzero(edge)
                k = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                at, k = at[keys[k] == key[at]], k[keys[k] == key[at]]
                first_doc[at], first_at[at], keep[at] = docs[k], ats[k], True
            cols = [b.column(2), b.column(3), b.column(4), pa.array(first_doc), pa.array(first_at)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], names=["doc_id", "at", "extra", "first_doc", "first_at"])

    rows = passed.where(F.col("kind") != SUMMARY).drop("size")
    return rows.mapInArrow(tidy(settle), "doc_id long, at int, extra long, first_doc long, first_at int")


def runs(texts: DataFrame, anchors: DataFrame, min_words: int, anchor: int) -> DataFrame:
    """run, doc_id, at: runs of min_words words of which the least anchor is a shared one, as it is in any two that are
    equal, save those within a settled match. anchors(doc_id, places: array of (at, first_doc, first_at))."""
    last, window = np.uint64((1 << 64) - 1), min_words - anchor + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, docs, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, h, places in zip(b.column(0).to_pylist(), hashed_texts(lazily(b.column(1))), lazily(b.column(2)), strict=True):
                short, long = fingerprints(h, min_words, anchor)
                if not len(long):
                    continue
                at = np.array([p["at"] for p in places], dtype=np.int64)
                at = at[at < len(short)]
                only = np.full(len(short), last)
                only[at] = short[at]
                emit = sliding(only, window, np.minimum) == sliding(short, window, np.minimum)
                known = sorted((p["at"], p["first_doc"], p["first_at"]) for p in places if p["first_doc"] is not None and (p["first_doc"], p["first_at"]) != (doc, p["at"]))
                for (p, d, q), (p2, d2, q2) in zip(known, known[1:], strict=False):
                    if d == d2 and p2 - p == q2 - q <= min_words and (d != doc or q < p):
                        emit[p + 1 : p2] = False
                for p, _, _ in known:  # known to be repeated
                    emit[p] = False
                i = np.flatnonzero(emit)
                fps.append(long[i])
                docs.append(np.full(len(i), doc))
                ats.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ats).astype(np.int32))], names=["run", "doc_id", "at"])

    # texts without a shared anchor need not be shuffled while the ids of those with one are few enough to broadcast
    texts = texts.join(small(anchors.select("doc_id")), "doc_id", "left_semi")
    return texts.join(anchors, "doc_id").select("doc_id", "text", "places").mapInArrow(tidy(work), "run long, doc_id long, at int")


def chains(min_words: int):
    """Of each document's hits (at, first_doc, first_at): those that continue each other, as passages of two documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = pc.list_flatten(b.column(1))
            doc = np.asarray(b.column(0).take(pc.list_parent_indices(b.column(1))))
            at, first, place = (hits.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "first_doc", "first_at"))
            by = np.lexsort((at, place - at, first, doc))
            doc, at, first, place = doc[by], at[by], first[by], place[by]
            new = np.ones(len(doc), dtype=bool)
            if len(doc):
                same = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]) & (place[1:] - at[1:] == place[:-1] - at[:-1])
                new[1:] = ~same | (at[1:] - at[:-1] > min_words)
            head = np.flatnonzero(new)
            end = np.append(head[1:], len(doc))[: len(head)] - 1
            cols = (doc[head], at[head], at[end] + min_words - at[head], first[head], place[head])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["doc_id", "start", "n", "first_doc", "first_start"])

    return work


def digest_passages(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, start, n, digest of the words of wanted(doc_id, start, n), a kept table, in the texts. A passage that does
    not end within its text has no digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for doc, text, spans in zip(b.column(0).to_pylist(), lazily(b.column(1)), lazily(b.column(2)), strict=True):
                words = encode(text).split()
                for x in spans:
                    if x["start"] + x["n"] <= len(words):
                        made = hashlib.blake2b(b" ".join(words[x["start"] : x["start"] + x["n"]]), digest_size=16).digest()
                        for c, v in zip(cols, (doc, x["start"], x["n"], made), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n", "digest"])

    spans = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = texts.join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    return texts.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(tidy(work), "doc_id long, start long, n long, digest binary")


def verified(passages: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of passages(doc_id, start, n, first_doc, first_start), a kept table, those whose words are equal."""
    there = passages.select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start"), "n")
    wanted = scratch.keep(passages.select("doc_id", "start", "n").unionByName(there).distinct(), f"{name}-wanted", NARROW)
    made = scratch.keep(digest_passages(texts, wanted), f"{name}-digests")
    other = made.select(F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"), "n", F.col("digest").alias("first_digest"))
    both = passages.join(made, ["doc_id", "start", "n"]).join(other, ["first_doc", "first_start", "n"]).where("digest = first_digest")
    return scratch.keep(both.select("doc_id", "start", "n", "first_doc", "first_start").distinct(), name, NARROW)


def repeated_spans(documents: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start (word), n_words, kept (the doc_ids where the passage occurs first): one row per maximal span of
    words that occur earlier. Clean documents have no row."""
    with Scratch(documents.sparkSession, "suffix") as scratch:
        return scratch.finish(_spans(documents, scratch, min_words, anchor))


def _spans(documents: DataFrame, scratch: Scratch, min_words: int, anchor: int) -> DataFrame:
    if not min_words // 2 < 2 * anchor or anchor >= min_words:
        raise ValueError("anchor must be shorter than min_words and not very short")
    texts = _texts(documents)
    suffixes = scratch.keep(retained(texts, min_words, anchor), "suffixes")
    shared = neighbours(suffixes, "head", scratch, "heads", extra="body")
    scratch.remove("suffixes")
    shared = scratch.keep(shared.select("doc_id", "at", F.col("extra").alias("body")), "shared", NARROW)
    scratch.remove("heads")
    known = scratch.keep(neighbours(shared.where("body is not null"), "body", scratch, "bodies").drop("extra"), "known", NARROW)
    scratch.remove("bodies")
    none = F.lit(None)
    places = known.unionByName(shared.select("doc_id", "at", none.cast("long").alias("first_doc"), none.cast("int").alias("first_at")))
    anchors = places.groupBy("doc_id").agg(F.collect_set(F.struct("at", "first_doc", "first_at")).alias("places"))
    anchors = scratch.keep(anchors, "anchors")
    scratch.remove("shared")
    found = scratch.keep(runs(texts, anchors, min_words, anchor), "runs")
    scratch.remove("anchors")
    again = neighbours(found, "run", scratch, "again").drop("extra")
    hits = again.unionByName(known).where("first_doc <> doc_id or first_at < at")
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("at", "first_doc", "first_at")).alias("hits"))
    passages = "doc_id long, start long, n long, first_doc long, first_start long"
    joined = scratch.keep(hits.mapInArrow(tidy(chains(min_words)), passages), "joined")
    for x in ("runs", "again", "known"):
        scratch.remove(x)
    good = verified(joined, texts, scratch, "verified")
    bad = scratch.keep(joined.join(good, joined.columns, "left_anti"), "unverified", NARROW)
    if not bad.isEmpty():  # a wrong match within a passage does not take the right ones with it
        single = bad.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - min_words)))
        single = single.select("doc_id", (F.col("start") + F.col("k")).alias("start"), F.lit(min_words).cast("long").alias("n"), "first_doc", (F.col("first_start") + F.col("k")).alias("first_start"))
        good = good.unionByName(verified(scratch.keep(single, "single", NARROW), texts, scratch, "verified-single"))
    spans = good.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "first_doc")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("kept", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for doc, places in zip(b.column(0).to_pylist(), lazily(b.column(1)), strict=True):
                start, end, kept = None, -1, set()
                for at, n, first in sorted((p["start"], p["n"], p["first_doc"]) for p in places):
                    if start is None or at > end:
                        if start is not None:
                            out.append((doc, start, end - start, sorted(kept)))
                        start, end, kept = at, at, set()
                    end = max(end, at + n)
                    kept.add(first)
                if start is not None:
                    out.append((doc, start, end - start, sorted(kept)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return spans.mapInArrow(tidy(merge), "doc_id long, start long, n_words long, kept array<long>")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words start .. start + n of each span; white space before a removed span goes too."""
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in TOKEN.finditer(data)]
    out, at = [], 0
    for start, n in sorted(spans):
        if start >= len(words):
            break
        last = min(start + n, len(words)) - 1
        out.append(data[at : words[start - 1][1] if start else 0])
        at = words[last][1]
    out.append(data[at:])
    return b"".join(x for x in out if x).decode("utf-8", "surrogatepass")


def remove_repeats(documents: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """documents with repeated passages cut out of text, and n_chars made anew. A text of which nothing but white space
    is left goes as a whole; rows without repeats stay as they are."""
    spans = repeated_spans(documents, min_words, anchor)
    few = spans.count()
    spans = spans.groupBy(F.col("doc_id").alias("__span_doc")).agg(F.collect_list(F.struct("start", "n_words")).alias("__spans"))
    spans = F.broadcast(spans) if few <= BROADCAST_IDS else spans

    @F.pandas_udf("string")
    def apply(text, spans):  # noqa: ANN001, ANN202
        return text.combine(spans, lambda t, s: cut(t, [(x["start"], x["n_words"]) for x in s]) if t is not None and s is not None else t)

    out = documents.join(spans, documents["doc_id"].cast("long") == F.col("__span_doc"), "left")
    changed = F.col("__spans").isNotNull() & F.col("text").isNotNull()
    hit = out.where(changed).withColumn("text", apply("text", "__spans"))
    hit = hit.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in documents.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return hit.select(documents.columns).unionByName(out.where(~changed).select(documents.columns))

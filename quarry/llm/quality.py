"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or abstain on every document. Expectation-maximisation estimates, from
how their votes agree over all documents, each labeller's rates of every vote for bad and for good documents, and with
them the posterior of every pattern of votes. The posteriors are the labels on which a hashed linear scorer is trained;
the scorer judges every document. No hand-made label is used, so those are free to measure it.

Texts are read once: votes, signals and hashed features of every whole text are kept as compact counts, from which the
scorer is trained and by which it judges. The driver sees one row per pattern of votes (at most 3 to the number of
labellers) and, of at most max_train documents chosen by a hash of doc_id and text, the max_features most frequent
features; votes, counts of patterns and scores cover all documents and whole texts.

Defined results: a null text counts as empty, gets no votes and is scored by its bias; rows that share a doc_id are each
judged by their own text; where the patterns hold but one class, or the table is empty, all documents are kept. Reruns
agree.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, encode, hash_words, lazily, ngrams, pick, tidy
from quarry.llm.rules import SYMBOLS, WINDOW

DIMS = 1 << 16
MAX_TRAIN, MAX_FEATURES = 4_000, 4_096
SHAPE = bytes.maketrans(bytes(range(256)), bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if c > 127 or 97 <= c <= 122 else b"0"[0] if 48 <= c <= 57 else c for c in range(256)))
#: name, statistic, votes bad above, votes good at or below (else abstains)
LABELLERS = (
    ("symbols", "symbols", 0.05, 0.005),
    ("marked_words", "marked", 0.3, 0.02),
    ("shouting", "upper", 0.5, 0.1),
    ("marks", "marks", 0.3, 0.05),
    ("repeated_windows", "windows", 0.3, 0.05),
    ("stutter", "stutter", 0.2, 0.03),
    ("same_lines", "lines", 0.5, 0.1),
    ("common_word", "common", 0.3, 0.15),
)
EDGES = (0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
SIGNALS = tuple(k for _, k, *_ in LABELLERS)


def signals(text: str, words: list[bytes], hashes: np.ndarray) -> dict[str, float]:
    """Shares, each from 0 to 1 or a little more."""
    n = max(1, len(words))
    windows = ngrams(hashes, WINDOW)
    repeated = 0
    if len(windows) > 1:
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        repeated = int((counts[inverse] > 1).sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "symbols": sum(map(text.count, SYMBOLS)) / max(1, len(text)),
        "marked": sum(w[-1] in b"*$%&#|!" for w in words) / n,
        "upper": sum(len(w) > 1 and w.isupper() for w in words) / n,
        "marks": (text.count("!") + text.count("?")) / n,
        "windows": repeated / max(1, len(windows)),
        "stutter": float((hashes[1:] == hashes[:-1]).sum()) / n,
        "lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "common": Counter(words).most_common(1)[0][1] / n if len(words) >= 30 else 0.1,
    }


def _parts(text: str | None) -> tuple[list[bytes], np.ndarray, bytes, dict[str, float] | None]:
    """Words, their hashes, the text in bytes and, if it has words, its signals."""
    data = encode(text)
    words, hashes = data.split(), hash_words(data)[0]
    return words, hashes, data, signals(text, words, hashes) if words else None


def _ballot(s: dict[str, float] | None) -> str:
    return "-" * len(LABELLERS) if s is None else "".join("b" if s[k] > bad else "g" if s[k] <= good else "-" for _, k, bad, good in LABELLERS)


def votes(text: str | None) -> str:
    """One letter a labeller: b, g, or - where it abstains; all abstain on a text without words."""
    return _ballot(_parts(text)[3])


RUNS = re.compile(rb"([^\x20\x09-\x0D])\1+")


#: What is kept of a text: votes, its signals, and places and counts of its words and of their shapes.
KEPT = "doc_id long, votes string, crc long, signals binary, words binary, n_words binary, shapes binary, n_shapes binary"


def describe(text: str | None) -> tuple[str, int, bytes, bytes, bytes, bytes, bytes]:
    """KEPT, but for doc_id. Shapes are words by classes of characters, repeated ones once."""
    words, hashes, data, s = _parts(text)
    if s is None:
        return _ballot(s), zlib.crc32(data), b"", b"", b"", b"", b""
    out = []
    for h in (hashes, hash_words(RUNS.sub(rb"\1+", data.translate(SHAPE)))[0] ^ np.uint64(0x5A5A)):
        at, n = np.unique((h % np.uint64(DIMS)).astype(np.uint16), return_counts=True)
        out += [at.astype("<u2").tobytes(), n.astype("<u4").tobytes()]
    return _ballot(s), zlib.crc32(data), np.array(list(s.values()), "<f8").tobytes(), *out


def vector(signals: bytes, *counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values from what describe keeps: damped frequencies of words and shapes, bands of the
    signals as they are."""
    if not signals:
        return np.zeros(0, np.int64), np.zeros(0)
    out_at, out_value = [], []
    for a, b in zip(counts[::2], counts[1::2], strict=True):
        at, n = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u4")
        value = np.log1p(n)
        out_at.append(at)
        out_value.append(value / np.sqrt((value**2).sum()))
    bands = [f"{k} {sum(v > e for e in EDGES)}" for k, v in zip(SIGNALS, np.frombuffer(signals, "<f8"), strict=True)]
    out_at.append(np.array([zlib.crc32(x.encode()) % DIMS for x in bands], dtype=np.int64))
    out_value.append(np.full(len(bands), 0.7))
    return np.concatenate(out_at), np.concatenate(out_value)


def estimate(patterns: pd.DataFrame, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """EM over patterns(votes, n): the posterior of bad for every pattern, and the model. Starts from the votes' majority."""
    symbols = "bg-"
    v = np.array([[symbols.index(c) for c in x] for x in patterns["votes"]])
    n = patterns["n"].to_numpy(float)
    b, g = (v == 0).sum(1), (v == 1).sum(1)
    p = np.clip((2 * b + 0.2) / (2 * b + 0.25 * g + 1.2), 0.02, 0.98)  # a bad vote is rarer than a good one and says more
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        rates = np.stack([np.stack([((n * w) @ (v == s) + 0.5) / ((n * w).sum() + 1.5) for s in range(3)]) for w in (p, 1 - p)])
        log = np.log(rates)[:, v, np.arange(v.shape[1])].sum(2)
        new = 1 / (1 + np.exp(np.clip(log[1] + np.log(1 - prior) - log[0] - np.log(prior), -50, 50)))
        new[(b + g) == 0] = prior
        if np.abs(new - p).max() < 1e-7:
            p = new
            break
        p = new
    accuracy = {name: {"bad": rates[0, 0, k] / (rates[0, :2, k].sum()), "good": rates[1, 1, k] / (rates[1, :2, k].sum())} for k, (name, *_) in enumerate(LABELLERS)}
    return p, {"prior": prior, "accuracy": accuracy}


def train(at: list[np.ndarray], value: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent; DIMS weights and a bias."""
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    col, val = np.concatenate(at), np.concatenate(value)
    w, m = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    weight = weight / weight.sum()
    for t in range(rounds):
        look = w + t / (t + 3) * m
        z = np.bincount(row, val * look[col], len(at)) + look[-1]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        g = np.append(np.bincount(col, val * d[row], DIMS), d.sum()) + decay * np.append(look[:-1], 0)
        new = look - 0.5 * g
        w, m = new, new - w
    return w


def _part(share: float) -> int:
    """Of 2^30 values of a hash, how many give this share."""
    return min(1 << 30, math.ceil(share * (1 << 30)))


def judge_quality(documents: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, threshold: float = 0.5) -> DataFrame:
    """doc_id, votes, crc (CRC-32 of the text in UTF-8), p_weak (posterior of bad by the votes), score (of bad by the
    scorer), keep."""
    with Scratch(documents.sparkSession, "quality") as scratch:
        return scratch.finish(_judged(documents, scratch, max_train, max_features, threshold))


def _judged(documents: DataFrame, scratch: Scratch, max_train: int, max_features: int, threshold: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("crc", pa.int64()), *((k, pa.binary()) for k in ("signals", "words", "n_words", "shapes", "n_shapes"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(describe, lazily(b.column(1))), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    kept = scratch.keep(pick(documents, doc_id="long", text="string").mapInArrow(tidy(read), KEPT), "kept")
    patterns = kept.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()
    weights, posterior = None, {}
    if len(patterns):
        p, _ = estimate(patterns)
        posterior = dict(zip(patterns["votes"], map(float, p), strict=True))
        # the two classes in equal numbers, the surest patterns only, drawn by hash; a few more than wanted are dropped
        draw = F.pmod(F.xxhash64("doc_id", "crc"), F.lit(1 << 30))
        rows = []
        for side in (p > 0.9, p < 0.1):
            n = int(patterns["n"][side].sum())
            if n:
                sure = kept.where(F.col("votes").isin(list(patterns["votes"][side]))).where(draw < _part(0.55 * max_train / n))
                few = sure.select(draw.alias("order"), "doc_id", "votes", "signals", *(_most(k, max_features) for k in ("words", "shapes")))
                rows.append(sorted(few.collect(), key=lambda r: tuple((x is not None, x) for x in r))[: max_train // 2])
        if len(rows) == 2:
            both = rows[0] + rows[1]
            target = np.array([posterior[r.votes] for r in both])
            weight = np.concatenate([np.full(len(x), 0.5 / len(x)) for x in rows])
            found = [vector(r.signals, *r.words, *r.shapes) for r in both]
            weights = train([a for a, _ in found], [v for _, v in found], target, weight)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.full(len(b), -50.0)
            if weights is not None:
                z = np.array([value @ weights[at] + weights[-1] for at, value in (vector(*x) for x in zip(*(lazily(c) for c in b.columns[3:]), strict=True))])
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            p = pa.array([posterior.get(x) for x in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], p, pa.array(s, pa.float64()), pa.array(s < threshold, pa.bool_())], names=["doc_id", "votes", "crc", "p_weak", "score", "keep"])

    return kept.mapInArrow(tidy(score), "doc_id long, votes string, crc long, p_weak double, score double, keep boolean")


def _most(name: str, most: int) -> Column:
    """places and counts of the most frequent features, so that what the driver gathers of a document is bounded."""

    @F.pandas_udf("at binary, n binary")
    def cut(at: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(at, n, strict=True):
            a, b = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u4")
            by = np.sort(np.argsort(-b.astype(np.int64), kind="stable")[:most])
            out.append((a[by].tobytes(), b[by].tobytes()))
        return pd.DataFrame(out, columns=["at", "n"])

    return cut(name, f"n_{name}").alias(name)

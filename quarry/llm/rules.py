"""Quality rules: decision lists learned by sequential covering and applied as ordered Spark conditions.

``statistics`` describes every whole text by counts. ``learn`` grows and prunes conjunctions of thresholds over
ratios of those counts, from labelled rows, and ``condition`` turns the list into one CASE expression, so that the
verdict itself runs in generated JVM code.

Defined results: a null text counts as empty; rows that share a doc_id each get their own row; a label that is null
or for an unknown doc_id teaches nothing; contradicting labels of a doc_id count as the smaller; with no labels at all
the list is empty and only the base rule rejects. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, Scratch, encode, hash_words, lazily, ngrams, pick, tidy

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks")
#: Ratios that rules test, as SQL over the counts.
RATIOS = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper_words / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}
#: Bound on the labelled rows that are gathered to learn from.
MAX_LABELLED = 20_000


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    text = text or ""
    data = encode(text)
    words = data.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeated = 0
    windows = ngrams(hash_words(data)[0], WINDOW)
    if len(windows) > 1:
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        if counts.max() > 1:
            twice = counts[inverse] > 1
            edge = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            np.subtract.at(edge, at + WINDOW, 1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
            sum(len(w) > 1 and w.isupper() for w in words), text.count("!") + text.count("?"))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*map(count, lazily(b.column(1))), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in rows)], names=["doc_id", *COUNTS])

    return pick(documents, doc_id="long", text="string").mapInArrow(tidy(work), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _best(x: np.ndarray, bad: np.ndarray, live: np.ndarray) -> tuple[float, tuple[int, str, float]] | None:
    """The threshold with the highest FOIL gain among the live rows."""
    p, n = int((live & bad).sum()), int((live & ~bad).sum())
    base, best = math.log2(p / (p + n)), None
    for j in range(x.shape[1]):
        order = np.argsort(x[live, j], kind="stable")
        v, y = x[live, j][order], bad[live][order]
        cp, ca = np.cumsum(y), np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        for op, a, b in (("<=", cp[cut], ca[cut]), (">", p - cp[cut], len(y) - ca[cut])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1e-9) / b) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = float(gain[k]), (j, op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def _holds(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, op, t in rule:
        out &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return out


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, most: int = 12, conditions: int = 4) -> list[list[tuple[int, str, float]]]:
    """Sequential covering. Two thirds of either class grow a rule by FOIL gain; the rest prune its last conditions
    while (p - n) / (p + n) does not fall. A rule that is not precise enough is put aside, and rules that start with
    its first statistic are not grown until another rule is found; the list ends when none is left to start with."""
    fold = np.zeros(len(x), dtype=bool)
    for side in (bad, ~bad):
        fold[np.flatnonzero(side)[2::3]] = True
    rules, open_, banned = [], np.ones(len(x), dtype=bool), set()
    while len(rules) < most:
        grow, check = open_ & ~fold, open_ & fold
        if (grow & bad).sum() < 4 or not (check & bad).any():
            break
        rule: list[tuple[int, str, float]] = []
        live = grow.copy()
        while len(rule) < conditions and (live & ~bad).any():
            use = [j for j in range(x.shape[1]) if rule or j not in banned]
            found = _best(x[:, use], bad, live) if use else None
            if found is None:
                break
            j, op, t = found[1]
            rule.append((use[j], op, t))
            live &= _holds(x, rule[-1:])
        if not rule:
            break

        def worth(r: list) -> float:
            hit = check & _holds(x, r)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p >= 2 else -1.0  # one row proves nothing

        first = rule[0][0]
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = open_ & _holds(x, rule)
        if (worth(rule) + 1) / 2 < precision or (hit & bad).sum() < precision * hit.sum():
            banned.add(first)
            continue
        rules.append(rule)
        banned.clear()
        open_ &= ~hit
    return rules


def condition(rules: list[list[tuple[int, str, float]]]) -> Column:
    """kept, as one ordered CASE: the first rule that holds rejects; else the row is kept."""
    names, out = list(RATIOS), None
    for rule in rules:
        test = F.lit(True)
        for j, op, t in rule:
            value = F.expr(RATIOS[names[j]]).cast("double")
            test = test & (value <= t if op == "<=" else value > t)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_quality_rules(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for every document. max_labelled bounds the labelled rows, drawn by a hash,
    that the driver gathers to learn the list; the statistics and the verdicts cover all rows."""
    with Scratch(documents.sparkSession, "rules") as scratch:
        stats = scratch.keep(statistics(documents), "stats")
        known = pick(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
        order = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1 << 30))
        judged = stats.where(~base).join(known, "doc_id").select(order.alias("order"), "doc_id", *[F.expr(v).cast("double").alias(k) for k, v in RATIOS.items()], "quality")
        judged = scratch.keep(judged, "judged")
        # the share is drawn before anything is gathered, so what reaches the driver does not grow with the tasks
        share = min(1.0, 1.05 * max_labelled / max(1, judged.count()))
        rows: pd.DataFrame = judged.where(F.col("order") < math.ceil(share * (1 << 30))).toPandas()
        rows = rows.sort_values(list(rows.columns), kind="stable")[:max_labelled]
        learned = learn(rows[list(RATIOS)].to_numpy(float), rows["quality"].to_numpy() == 0)
        return scratch.finish(stats.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & condition(learned)))

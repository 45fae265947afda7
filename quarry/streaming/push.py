"""Chunking of streams that arrive in slices, with Structured Streaming state per upload."""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import digest
from quarry.functions.cdc import ChunkOptions, SliceCutter

CHUNK = "upload string, seq long, offset long, length long, hash string, status string"


def _feed(state: tuple, slices: list[tuple[int, bytes, bool]], options: ChunkOptions) -> tuple[tuple, list[tuple]]:
    """Slices in order of slice_no; those that come early wait in state. is_last finishes the upload."""
    tail, place, finished, wanted, seq, waiting = state
    cutter, out = SliceCutter(options, tail, place, finished), []
    for n, data, last in slices:
        if finished or n < wanted or n in waiting:
            out.append((-1, -1, 0, None, "push after finish" if finished else "duplicate slice"))
        else:
            waiting[n] = (bytes(data or b""), bool(last))
    while wanted in waiting:
        data, last = waiting.pop(wanted)
        wanted += 1
        if finished:
            out.append((-1, -1, 0, None, "push after finish"))
            continue
        done = cutter.push(data) + (cutter.finish() if last else [])
        finished = finished or last
        for o, piece in done:
            out.append((seq, o, len(piece), hashlib.sha256(piece).hexdigest(), "ok"))
            seq += 1
    if finished:
        out += [(-1, -1, 0, None, "push after finish")] * len(waiting)
        waiting.clear()
    return (cutter.tail, cutter.place, finished, wanted, seq, waiting), out


def push_chunks(slices: DataFrame, options: ChunkOptions) -> DataFrame:
    """CHUNK rows of a stream of slices(upload string, slice_no long, data binary, is_last boolean)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else (b"", 0, False, 0, 0, {})
        rows = [r for df in batches for r in zip(df["slice_no"], df["data"], df["is_last"], strict=True)]
        held, out = _feed(held, sorted(rows, key=lambda r: r[0]), options)
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["upload", "seq", "offset", "length", "hash", "status"])

    return slices.groupBy("upload").applyInPandasWithState(update, CHUNK, "held binary", "append", GroupStateTimeout.NoTimeout)


#: Slices of one upload that are Python objects at once.
TAKEN = 256


def push_chunks_batch(slices: DataFrame, options: ChunkOptions) -> DataFrame:
    """The same over a table of all slices. Those of an upload come in order, one task's uploads in one go, so that
    neither an upload is held whole nor a function called for each."""
    names, types = zip(*(c.split(" ") for c in CHUNK.split(", ")), strict=True)
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in zip(names, types, strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, (), False
        for b in batches:
            for at in range(0, len(b), TAKEN):
                rows = []
                for upload, run in itertools.groupby(zip(*(c.to_pylist() for c in b.slice(at, TAKEN).columns), strict=True), key=lambda r: r[0]):
                    if not begun or upload != current:
                        current, state, begun = upload, (b"", 0, False, 0, 0, {}), True
                    run = [r[1:] for r in run]
                    again = [r for r in run if state[2] and r[0] < state[3]]  # of slices taken before, wherever a batch ends
                    state, out = _feed(state, [r for r in run if not (state[2] and r[0] < state[3])], options)
                    rows += [(upload, *r) for r in out] + [(upload, -1, -1, 0, None, "duplicate slice")] * len(again)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    ordered = slices.select("upload", "slice_no", "data", "is_last").repartition("upload").sortWithinPartitions("upload", "slice_no")
    return ordered.mapInArrow(work, CHUNK)


def append_witness(actions: DataFrame) -> DataFrame:
    """log, seq, entry of a stream of actions(log string, seq long, action_hash binary, timestamp_ns long,
    witness_type int): each micro-batch goes on from the last entry of its log."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = bytes(state.get[0]) if state.exists else bytes(32)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, action, ns, kind in zip(rows["seq"], rows["action_hash"], rows["timestamp_ns"], rows["witness_type"], strict=True):
            entry = digest.ENTRY.pack(previous, bytes(action), int(ns), int(kind))
            previous = digest.shake256(entry)
            out.append((key[0], seq, entry))
        state.update((previous,))
        yield pd.DataFrame(out, columns=["log", "seq", "entry"])

    return actions.groupBy("log").applyInPandasWithState(update, "log string, seq long, entry binary", "previous binary", "append", GroupStateTimeout.NoTimeout)

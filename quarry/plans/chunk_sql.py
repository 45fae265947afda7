"""Chunk cuts in SQL, for comparison: the definition of content-defined chunking set by set instead of byte by byte.

The gear values follow from MD5, as published. The hash that ends at a byte depends, in the 42 bits that the masks of
small chunks look at, on the last 42 bytes; doubling a window six times gives it for every byte. Within a chunk it starts
anew at the least cut, so there the part of earlier bytes is taken off again. Cuts follow each other by recursion, one
step a chunk.
"""

from __future__ import annotations

from quarry.functions.cdc import ChunkOptions

BITS = 42
ALL = (1 << BITS) - 1


def _double(width: int, before: str) -> str:
    keep = (1 << (BITS - width)) - 1
    return f"select doc_id, p, (w + ((coalesce(lag(w, {width}) over o, 0) & {keep}) << {width})) & {ALL} as w from {before} window o as (partition by doc_id order by p)"


def chunks_sql(options: ChunkOptions) -> str:
    """Common table expressions that end in chunks(doc_id, seq, offset, length, hash) of documents(doc_id, text)."""
    strict, loose = options.masks
    if max(strict, loose) > ALL:
        raise ValueError(f"masks beyond bit {BITS} need wider windows")
    least, avg, most = options.min_size, options.avg_size, options.max_size
    start = 2 * (least // 2)
    steps, before = [], "w0"
    for width in (1, 2, 4, 8, 16, 32):
        steps.append(f"w{width} as ({_double(width, before)})")
        before = f"w{width}"
    return f"""
with recursive gear as (
  select b, (('0x' || substr(md5(unhex(repeat(printf('%02x', b), 64))), 1, 16))::UBIGINT & {ALL})::BIGINT as g from range(256) r(b)),
raw as (select doc_id, hex(encode(text)) as h from documents),
w0 as (
  select doc_id, p, g as w from (
    select doc_id, p, ('0x' || substr(h, (2 * p + 1)::INTEGER, 2))::INTEGER as b from (select doc_id, h, unnest(range(length(h) // 2)) as p from raw)) join gear using (b)),
{", ".join(steps)},
hashed as materialized (select doc_id, count(*)::BIGINT as n, list(w order by p) as w from w32 group by doc_id),
cuts(doc_id, seq, pos, length) as (
  select doc_id, -1, 0::BIGINT, 0::BIGINT from hashed
  union all
  select doc_id, seq + 1, pos, case when n - pos <= {least} then n - pos else coalesce(
    list_filter(range({start}, 2 * (least(n - pos, {most}) // 2)), lambda k:
      ((w[pos + k + 1] - case when k < {start + BITS - 1} then (w[pos + {start}] & ((1::BIGINT << ({start + BITS - 1} - k)) - 1)) << (k - {start - 1}) else 0 end)
        & case when k < 2 * (case when n - pos < {avg} then n - pos else {avg} end // 2) then {strict} else {loose} end) = 0)[1],
    least(n - pos, {most})) end
  from (select doc_id, seq, c.pos + c.length as pos, n, w from cuts c join hashed using (doc_id)) where pos < n),
chunks as (
  select doc_id, seq::INTEGER as seq, pos as "offset", length, sha256(unhex(substr(h, (2 * pos + 1)::INTEGER, (2 * length)::INTEGER))) as hash
  from cuts join raw using (doc_id) where seq >= 0)
"""

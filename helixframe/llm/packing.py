"""Best-fit packing of token sequences, planned over counts of lengths.

The plan sees only how many pieces there are of each length (at most `capacity` numbers), not the
pieces. It fills sequences by best fit in decreasing length; equal sequences are planned as one
group, so it takes at most a few rows per length at any number of documents. Each piece then takes
a planned slot: the one at its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.ranks import BUCKET_ROWS, spread_ranks
from helixframe.llm.tokens import encoder
from helixframe.session import cut_lineage

CAPACITY = 1024
END_OF_TEXT = 2


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots for counts[length] pieces of each length, as rows
    (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Best fit decreasing: a piece goes to the fullest sequence that still holds it. Sequences with
    the same room are one group, a range of sequence numbers. A length fills whole groups, and
    splits one at most, so groups and rows stay below a small multiple of `capacity`.
    """
    rows, rooms, groups, opened = [], [], {}, 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                first, n = opened, -(-left // each)
                opened += n
                room = capacity
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last pieces of this length share one sequence
                rows.append((length, rank, left, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(room, first + full, n - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def slot_of(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the piece with this rank among those of its length."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    starts = np.searchsorted(plan[:, 0], length, "left")
    stops = np.searchsorted(plan[:, 0], length, "right")
    at = np.empty(len(length), dtype=np.int64)
    for value in np.unique(length):
        mine = np.flatnonzero(length == value)
        low, high = starts[mine[0]], stops[mine[0]]
        at[mine] = low + np.searchsorted(plan[low:high, 1], rank[mine], "right") - 1
    row = plan[at]
    inside = rank - row[:, 1]
    return row[:, 3] + inside // row[:, 4], row[:, 5] + (inside % row[:, 4]) * length


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only a longer one is cut, the first may be shorter."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(s, (starts[i + 1] if i + 1 < len(starts) else total) - s) for i, s in enumerate(starts)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_OF_TEXT, tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if tokens=True) of every document."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if tokens:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end], dtype="<u4")
                    for piece, (start, length) in enumerate(cut_pieces(ids.size, capacity)):
                        held = ids[start:start + length]
                        row = (key, piece, start, length, zlib.crc32(held.tobytes()))
                        out.append((*row, held.astype(np.int32)) if tokens else row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if tokens else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, kind)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, start, length, ids_crc32).

    `pieces` is read three times and should be a written table. The counts of lengths that come
    to the driver are at most `capacity` rows, and so is, up to a small factor, the plan that goes
    to the tasks. A length that many pieces share is ranked in parts.
    """
    counts = {row.length: row.n for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_best_fit(counts, capacity)
    parts = F.create_map(*[F.lit(x) for length in counts for x in (length, max(1, counts[length] // BUCKET_ROWS))]) if counts else None
    buckets = F.coalesce(F.element_at(parts, F.col("length")), F.lit(1)) if counts else F.lit(1)
    ranked = spread_ranks(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], buckets)

    def place(batches):
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "length"))
            sequence, offset = slot_of(plan, length, rank)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            names = [batch.schema.names[i] for i in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = [f for f in ranked.schema.fields if f.name != "rank"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return ranked.mapInArrow(place, f"{kind}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END_OF_TEXT) -> DataFrame:
    """Pieces of all documents with their place. A null text is empty (one piece, the end token).

    Rows with equal ids or texts are packed like any other; no document gives no row only if the
    table is empty. Documents are tokenized once, in tasks; only the pieces table moves.
    """
    return pack(cut_lineage(token_pieces(docs, tokenizer, capacity, end)), capacity)

"""Packing of token sequences by shortest-pack-first over the length histogram.

The histogram of piece lengths has at most ``capacity`` entries, whatever the size of
the corpus. Packing works on these counts alone and yields patterns (lists of lengths) with
how often each is used; pieces then find their pattern by their rank among pieces of their
length, a range lookup in a table whose size depends on the capacity only.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmatide.llm.common import RANK, documents_of, in_worker, ranked
from sigmatide.llm.tokens import encoder
from sigmatide.session import staged

CAPACITY, END_ID = 1024, 0
BATCH_BYTES = 8 << 20


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids, doc_tokens.

    A document's ids are those of its text and ``end_id``; null text is empty, so it has the
    end id only. ``ids`` are little-endian unsigned 32-bit numbers. ``doc_tokens`` is the
    document's number of ids.
    """
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            for doc_id, found in zip(batch.column(0), encode(batch.column(1))):
                ids = found + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc_id.as_py(), start, len(piece) // 4, piece, n))
                    size += len(piece)
                    if size > BATCH_BYTES:
                        yield _batch(rows, columns, batch.schema.field(0).type)
                        rows, size = [], 0
            yield _batch(rows, columns, batch.schema.field(0).type)

    source = documents_of(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        in_worker(run, "encoders"), f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long")


def _batch(rows: list[tuple], columns: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    values = list(zip(*rows)) or [()] * len(columns)
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds)], columns)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; every pattern fits the capacity.

    Lengths are placed longest first. Each goes onto the packs with the most room while
    it fits there, as many packs at once as there are pieces, else into new packs.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in by_room:
            by_room[room] = []
            heappush(rooms, -room)
        by_room[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left, filled = counts[length], []
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            pattern, n = by_room[room].pop()
            used = min(n, left)
            left -= used
            filled.append((room - length, (*pattern, length), used))
            if n > used:
                by_room[room].append([pattern, n - used])
            if not by_room[room]:
                del by_room[room]
                heappop(rooms)
            for item in filled:
                put(*item)
            filled = []
        if left:
            each = capacity // length if length else 1
            whole, rest = divmod(left, each)
            for n, size in ((whole, each), (int(rest > 0), rest)):
                if n:
                    put(capacity - size * length, (length,) * size, n)
    return sorted(((pattern, n) for packs in by_room.values() for pattern, n in packs),
                  key=lambda x: (-sum(x[0]), x[0]))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: by (length, first rank) the first sequence and the offset in it."""
    rows, used, first = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, first, offset))
            used[length] = rank + n
            offset += length
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: each piece in exactly one place.

    ``pieces`` has a long column ``length`` of 1 to ``capacity``; all other columns stay (text
    belongs elsewhere: rows are sorted). Sequences are numbered from 0 and
    filled from offset 0 without gaps. Equal rows get places of their own; no pieces give no
    sequences. Pieces of one length are ranked by a distributed sort, so that a length
    that a third of all pieces share is not gathered in one task.
    """
    names = pieces.columns
    clash = {"sequence_id", "offset"}.intersection(names)
    if clash:
        raise ValueError(f"pieces have columns named as the result's: {sorted(clash)}")
    order = ranked(pieces, ["length", *[c for c in names if c != "length"]])
    histogram = sorted((r["length"], r["n"]) for r in
                       pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    if histogram and not 1 <= histogram[0][0] <= histogram[-1][0] <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = _slots(pack_lengths(dict(histogram), capacity))
    shorter = np.zeros(capacity + 2, np.int64)
    for length, n in histogram:
        shorter[length + 1] = n
    shorter = np.cumsum(shorter)
    shift = 1 << 42  # a rank of one length stays below
    keys = slots["length"] * shift + slots["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(RANK).to_numpy(zero_copy_only=False) - shorter[length]
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(slots["sequence"][at] + rank - slots["rank"][at]),
                 pa.array(slots["offset"][at])],
                [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return order.mapInArrow(in_worker(run, "encoders"), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids and ids (padded to the capacity) of packed pieces that carry ``ids``."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(in_order.alias("parts"), F.sum("length").alias("n_ids"))
    pad = int(pad_id).to_bytes(4, "little").hex()
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    padding = F.unhex(F.repeat(F.lit(pad), (F.lit(capacity) - F.col("n_ids")).cast("int")))
    return whole.select("sequence_id", "n_ids", F.concat(ids, padding).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, places of the pieces): the ids are written once, and
    only the narrow columns are sorted. Both carry doc_id and start."""
    pieces = staged(token_pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id), "pieces")
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pieces, pack(narrow, capacity)

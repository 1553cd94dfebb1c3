"""Repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts somewhere else.

Suffixes. A suffix array of every position is far larger than the text, so suffixes are sampled by
content: of the GRAM-byte strings in a window of ``length`` bytes the one with the smallest hash is the
window's anchor. Equal windows have the same anchor at the same place, and the windows of one
anchor follow each other, so a *context*, the suffix from an anchor's first window to the end of its
last, stands for all of them. One position in about sixty starts a context.

Filter. Contexts are counted by hash; strings that occur once are not sorted. Equal strings have
equal hashes, so no repeat is lost.

Sort. A task sorts the contexts of its run of text and front-codes them: each string as the
length of the prefix that it shares with the string before, and the rest. Runs are exchanged by
bucket. A bucket merges its runs with a loser tree that keeps for each string the length of the
prefix it shares with the string it lost to, compares these lengths first, and looks at characters
behind them only: known prefixes are never compared again. Strings that come out equal repeat.

Edges. Where a repeated passage begins or ends within a context, that context differs from
all others though some of its windows repeat. Windows of contexts that share their anchor's string
with other contexts are therefore counted one by one, by a 96-bit hash.

Texts stay where they are: runs are written once, bucketed by run, and only sorted strings, hashes
and one reply code per context travel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmatide.llm.common import documents_of
from sigmatide.session import partitions_of, shared_folder, staged

LENGTH, GRAM = 200, 73
RUN_BYTES = 8 << 20  # text of a run, at least one document
BUCKET_BYTES = 16 << 20  # text for which there is one bucket
SEGMENT = 1 << 20  # window starts hashed at a time
CONTEXTS, WINDOWS = 0, 1  # kinds of exchanged blocks
REPEATED, MIXED, HOLDER = 1, 2, 4  # reply codes of a context

_BASES = (0x9E3779B97F4A7C15, 0x5851F42D4C957F2D)
_MIXERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9))
_POSITION = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray, which: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIXERS[which]
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """64-bit hashes of any stretch of a segment, from sums over its prefixes."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n, self.which = len(data) + 1, which
        known = self._powers.get(which)
        if known is None or len(known[0]) < n:
            both = []
            for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
                powers = np.full(max(n, SEGMENT + 512), base, np.uint64)
                powers[0] = 1
                both.append(np.multiply.accumulate(powers))
            known = self._powers[which] = tuple(both)
        self.down = known[1]
        self.sums = np.zeros(n, np.uint64)
        # A byte counts as 1 to 256, so that a zero byte counts too.
        np.cumsum((data + np.uint64(1)) * known[0][:n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts], self.which)

    def fixed(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n], self.which)


@dataclass
class Contexts:
    """The contexts of a run in text order, by position in the run."""

    gram: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first window
    count: np.ndarray  # windows
    anchor: np.ndarray  # from the first window to the anchor


def _segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        yield at, data[at:at + SEGMENT + length - 1]


def contexts(data: np.ndarray, sizes: np.ndarray, length: int) -> Contexts:
    """Contexts of the documents that follow each other in ``data``; none crosses documents."""
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    gram = min(GRAM, length)
    span = length - gram + 1
    found = []
    for at, part in _segments(data, length):
        windows = len(part) - length + 1
        valid = np.flatnonzero(room[at:at + windows] >= length)
        if not len(valid):
            continue
        hasher = _Hasher(part, 0)
        grams = hasher.fixed(gram)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[:size - span], least[span - size:])
        anchor = (least[valid] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        first, anchor = valid[new], anchor[new]
        count = np.diff(new, append=len(valid))
        place = (anchor - first).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
        whole = hasher.of(first, first + count - 1 + length)
        found.append((grams[anchor], _mix(whole ^ place * _MIXERS[1]), first + at, count, anchor - first))
    if not found:
        empty = np.empty(0, np.int64)
        return Contexts(empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty)
    return Contexts(*(np.concatenate(x) for x in zip(*found)))


@dataclass
class Distinct:
    """The distinct contexts of a run, sorted by bucket, gram and hash."""

    bucket: np.ndarray
    gram: np.ndarray
    hash: np.ndarray
    often: np.ndarray  # more than once in the run
    example: np.ndarray  # an index into the contexts
    which: np.ndarray  # of each context its distinct one


def _content(c: Contexts, raw: bytes, length: int) -> Callable[[int], tuple[bytes, int]]:
    """What a context is: its string, and where its anchor lies."""
    first, ends, anchor = c.first.tolist(), (c.first + c.count - 1 + length).tolist(), c.anchor.tolist()
    return lambda i: (raw[first[i]:ends[i]], anchor[i])


def distinct(c: Contexts, buckets: int, raw: bytes, length: int) -> Distinct:
    """Contexts are the same if their strings and anchors are; hashes only bring them together."""
    bucket = (c.gram % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((c.hash, c.gram, bucket))
    gram, own, at = c.gram[order], c.hash[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    content = _content(c, raw, length)
    heads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    clashes = {h for i, h in zip(np.flatnonzero(~new).tolist(), heads[~new].tolist())
               if content(order[i]) != content(order[h])}
    for h in clashes:  # different contexts under one hash: put equal ones side by side
        end = h + int((heads == h).sum())
        order[h:end] = sorted(order[h:end].tolist(), key=content)
        new[h + 1:end] = [content(a) != content(b) for a, b in zip(order[h:end - 1].tolist(), order[h + 1:end].tolist())]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    often = np.diff(heads, append=len(order)) > 1
    return Distinct(at[heads], gram[heads], own[heads], often, order[heads], which)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal bucket in a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
        if b > a:
            yield int(bucket[a]), slice(int(a), int(b))


# Runs

def _pack_run(ids: list, texts: list[bytes], compress: Callable[[bytes], bytes]) -> tuple:
    return (uuid.uuid4().int >> 65, ids, [len(t) for t in texts], compress(b"".join(texts)))


def _runs(docs: DataFrame) -> DataFrame:
    """run, ids, sizes, texts: documents in runs, written once and bucketed by run."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = _pack_run(ids, texts, compress)
            kinds = (pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], ["run", "ids", "sizes", "texts"])

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                content = text.as_py() or b""
                if texts and size + len(content) > RUN_BYTES:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(content)
                size += len(content)
        if texts:
            yield out()

    packed = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"run long, ids array<{id_type}>, sizes array<bigint>, texts binary")
    name = f"suffix_runs_{uuid.uuid4().hex}"
    packed.write.bucketBy(partitions_of(spark), "run").option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def _open(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Run number, sizes and bytes of a run."""
    sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
    raw = zstandard.ZstdDecompressor().decompress(
        batch.column("texts")[row].as_py(), max_output_size=max(1, int(sizes.sum())))
    return batch.column("run")[row].as_py(), sizes, np.frombuffer(raw, np.uint8)


# Counting of contexts

def _context_hashes(runs: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, sizes, data = _open(batch, row)
                d = distinct(contexts(data, sizes, length), buckets, data.tobytes(), length)
                rows = [(b, number, d.gram[s].tobytes(), d.hash[s].tobytes(),
                         np.packbits(d.often[s]).tobytes()) for b, s in _by_bucket(d.bucket)]
                yield _table(rows, "bucket number gram hash often".split(),
                             [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], "run")

    return runs.mapInArrow(run, "bucket long, run long, gram binary, hash binary, often binary")


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType], second: str) -> pa.RecordBatch:
    values = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                      [second if n == "number" else n for n in names])


REPLY = "run long, kind int, bucket long, codes binary"
_REPLY_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _context_codes(blocks: DataFrame) -> DataFrame:
    """For each run and bucket a code per context: repeated, sharing its gram with other
    contexts, and then whether this run stands for the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _groups(batches, 1):
            gram, own = (np.concatenate([np.frombuffer(r[i], np.uint64) for r in rows]) for i in (1, 2))
            sizes = [len(r[1]) // 8 for r in rows]
            often = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=n)
                                    for r, n in zip(rows, sizes)]).astype(bool)
            order = np.lexsort((own, gram))
            g, h = gram[order], own[order]
            new_gram = np.append(True, g[1:] != g[:-1])
            new = new_gram | np.append(True, h[1:] != h[:-1])
            group = np.cumsum(new) - 1
            times = np.bincount(group) > 1
            several = np.bincount(group, often[order]) > 0
            of_gram = np.cumsum(new_gram) - 1
            # One run sends different contexts under one hash: all of them stand for themselves.
            owner = np.repeat(np.arange(len(rows)), sizes)[order]
            clash = np.bincount(group, ~new & np.append(False, owner[1:] == owner[:-1])) > 0
            mixed = (np.bincount(of_gram, new) > 1) | (np.bincount(of_gram, clash[group]) > 0)
            code = np.empty(len(order), np.uint8)
            code[order] = ((times | several)[group] * REPEATED + mixed[of_gram] * MIXED
                           + (mixed[of_gram] & (new | clash[group])) * HOLDER)
            parts = np.split(code, np.cumsum(sizes)[:-1])
            yield _table([(r[0], CONTEXTS, bucket, p.tobytes()) for r, p in zip(rows, parts)],
                         ["number", "kind", "bucket", "codes"], _REPLY_KINDS, "run")

    return (blocks.repartition("bucket").sortWithinPartitions("bucket", "run")
            .mapInArrow(run, REPLY))


# Sorted runs and their merge

def front_code(strings: list[bytes]) -> bytes:
    """A sorted list of distinct strings: shared prefix lengths, rest lengths, rests."""
    size = max(map(len, strings))
    grid = np.zeros((len(strings), size + 1), np.uint8)
    for row, s in zip(grid, strings):
        row[:len(s)] = np.frombuffer(s, np.uint8)
    lengths = np.array([len(s) for s in strings])
    differs = grid[1:] != grid[:-1]
    shared = np.zeros(len(strings), np.int64)
    shared[1:] = np.where(differs.any(1), differs.argmax(1), size)
    shared[1:] = np.minimum(shared[1:], np.minimum(lengths[1:], lengths[:-1]))
    head = np.concatenate(([len(strings)], shared, lengths - shared)).astype("<u4").tobytes()
    return head + b"".join(s[n:] for s, n in zip(strings, shared))


def front_decode(block: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, length of the prefix shared with the string before)."""
    n = int.from_bytes(block[:4], "little")
    shared, rests = np.frombuffer(block, "<u4", 2 * n, 4).reshape(2, n).tolist()
    at, last = 4 + 8 * n, b""
    for keep, rest in zip(shared, rests):
        last = last[:keep] + block[at:at + rest]
        at += rest
        yield last, keep


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known:known + 32], b[known:known + 32]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + (n - (differ.bit_length() + 7) // 8 if differ else n)
        known += 32
    return end


def merge(streams: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(string, prefix shared with the string put out before, stream) in sorted order.

    A loser tree: an inner node holds the stream that lost there and, in ``known``, the length of
    the prefix its string shares with the one it lost to. On the way up from the stream that
    was put out all these lengths refer to the string put out, so of two strings the one with
    the longer shared prefix is smaller, and only equal lengths need a look at the characters.
    """
    k = 1
    while k < len(streams):
        k *= 2
    now: list[bytes | None] = [None] * k
    known = [0] * k

    def advance(s: int) -> None:
        now[s], known[s] = next(streams[s], (None, 0)) if s < len(streams) else (None, 0)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared_prefix(x, y, known[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for s in range(k):
        advance(s)
    losers, level = [0] * k, list(range(k))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            losers[len(level) // 2 + i // 2] = loser
            up.append(winner)
        level = up
    winner = level[0]
    while now[winner] is not None:
        yield now[winner], known[winner], winner
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _replies(batch: pa.RecordBatch, row: int, column: str) -> dict[tuple[int, int], np.ndarray]:
    found = batch.column(column)[row].as_py() or []
    return {(r["kind"], r["bucket"]): np.frombuffer(r["codes"], np.uint8) for r in found}


def _codes(d: Distinct, replies: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    parts = [replies[CONTEXTS, b] for b, _ in _by_bucket(d.bucket)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def _edge_windows(c: Contexts, d: Distinct, codes: np.ndarray, data: np.ndarray, buckets: int,
                  length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts that this run stands for, sorted by bucket: start, hash, tag."""
    own = np.sort(d.example[(codes & HOLDER) > 0])
    first, count = c.first[own], c.count[own]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(first, count) + within
    place = (np.repeat(c.anchor[own], count) - within).astype(np.uint64)
    tags = (_mix(np.repeat(c.gram[own], count) ^ place * _MIXERS[0], 1) >> np.uint64(32)).astype(np.uint32)
    hashes = np.empty(len(starts), np.uint64)
    for at, part in _segments(data, length):
        a, b = np.searchsorted(starts, (at, at + SEGMENT))
        if b > a:
            low = starts[a:b] - at
            hashes[a:b] = _Hasher(part, 1).of(low, low + length)
    order = np.argsort(hashes % np.uint64(buckets), kind="stable")
    return starts[order], hashes[order], tags[order]


def _blocks(runs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Front-coded sorted contexts and window hashes by kind and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, sizes, data = _open(batch, row)
                c = contexts(data, sizes, length)
                raw = data.tobytes()
                d = distinct(c, buckets, raw, length)
                codes, rows = _codes(d, _replies(batch, row, "first")), []
                for bucket, s in _by_bucket(d.bucket):
                    own = np.flatnonzero(codes[s] & REPEATED)
                    if len(own):
                        own += s.start
                        strings, order = _sorted_contexts(c, d, own, raw, length)
                        often = np.packbits(d.often[own[order]]).tobytes()
                        rows.append((CONTEXTS, bucket, number, front_code(strings), often))
                starts, hashes, tags = _edge_windows(c, d, codes, data, buckets, length)
                for bucket, s in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64)):
                    rows.append((WINDOWS, bucket, number, hashes[s].tobytes(), tags[s].tobytes()))
                yield _table(rows, ["kind", "bucket", "number", "content", "extra"],
                             [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], "run")

    return runs.mapInArrow(run, "kind int, bucket long, run long, content binary, extra binary")


def _sorted_contexts(c: Contexts, d: Distinct, own: np.ndarray, raw: bytes,
                     length: int) -> tuple[list[bytes], list[int]]:
    """Strings of the distinct contexts ``own``, each with the place of its anchor behind it, in
    sorted order, and that order."""
    examples = d.example[own]
    ends = c.first[examples] + c.count[examples] - 1 + length
    strings = [raw[a:b] + n.to_bytes(2, "big") for a, b, n in
               zip(c.first[examples].tolist(), ends.tolist(), c.anchor[examples].tolist())]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return [strings[i] for i in order], order


def _merge_contexts(rows: list[tuple]) -> list[np.ndarray]:
    """Of each run's block which strings repeat, in the block's order."""
    streams = [front_decode(content) for _, content, _ in rows]
    sizes = [int.from_bytes(content[:4], "little") for _, content, _ in rows]
    verdicts = [np.unpackbits(np.frombuffer(extra, np.uint8), count=n)
                for (_, _, extra), n in zip(rows, sizes)]
    seen = [0] * len(rows)
    last, holders = b"", []

    def settle() -> None:
        if len(holders) > 1 or holders and verdicts[holders[0][0]][holders[0][1]]:
            for stream, at in holders:
                verdicts[stream][at] = 1

    for string, known, stream in merge(streams):
        if not (known == len(last) == len(string)):
            settle()
            holders = []
        holders.append((stream, seen[stream]))
        seen[stream] += 1
        last = string
    settle()
    return verdicts


def _count_windows(rows: list[tuple]) -> list[np.ndarray]:
    hashes = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
    tags = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    order = np.lexsort((tags, hashes))
    h, t = hashes[order], tags[order]
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    verdict = np.zeros(len(order), np.uint8)
    verdict[order] = np.append(same, False) | np.append(False, same)
    return np.split(verdict, np.cumsum([len(r[1]) // 8 for r in rows])[:-1])


def _verdicts(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), rows in _groups(batches, 2):
            found = _merge_contexts(rows) if kind == CONTEXTS else _count_windows(rows)
            yield _table([(r[0], kind, bucket, np.packbits(v).tobytes()) for r, v in zip(rows, found)],
                         ["number", "kind", "bucket", "codes"], _REPLY_KINDS, "run")

    return (blocks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "run")
            .mapInArrow(run, REPLY))


# Removal

def _repeated(c: Contexts, d: Distinct, codes: np.ndarray, verdicts: dict, data: np.ndarray,
              buckets: int, length: int) -> np.ndarray:
    """Which bytes of a run lie in a repeated string."""
    again = np.zeros(len(codes), bool)
    raw = data.tobytes()
    for bucket, s in _by_bucket(d.bucket):
        own = np.flatnonzero(codes[s] & REPEATED) + s.start
        if len(own):
            _, order = _sorted_contexts(c, d, own, raw, length)
            again[own[order]] = np.unpackbits(verdicts[CONTEXTS, bucket], count=len(own)).astype(bool)
    whole = again[d.which]
    starts, hashes, _ = _edge_windows(c, d, codes, data, buckets, length)
    single = [np.unpackbits(verdicts[WINDOWS, b], count=s.stop - s.start)
              for b, s in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64))]
    starts = starts[np.concatenate(single).astype(bool)] if single else starts
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.concatenate((c.first[whole], starts)), 1)
    np.add.at(change, np.concatenate((c.first[whole] + c.count[whole] - 1, starts)) + length, -1)
    return np.cumsum(change[:-1]) > 0


def _removed(runs: DataFrame, buckets: int, length: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, sizes, data = _open(batch, row)
                c = contexts(data, sizes, length)
                d = distinct(c, buckets, data.tobytes(), length)
                codes = _codes(d, _replies(batch, row, "first"))
                gone = _repeated(c, d, codes, _replies(batch, row, "second"), data, buckets, length)
                rows = []
                for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                    own, text = gone[end - size:end], data[end - size:end]
                    if own.any():
                        edges = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0))
                        rows.append((size, int(own.sum()), edges.reshape(-1, 2).tolist(), text[~own].tobytes()))
                    else:
                        rows.append((size, 0, [], text.tobytes()))
                ids = batch.column("ids")[row].values
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return runs.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, "
                                "spans array<array<bigint>>, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans, kept.

    Texts are UTF-8 bytes, null is empty. Removed is every byte that lies in a string of ``length``
    bytes that starts at another place too, in the same or another document, overlaps
    included; strings are judged on the input. ``spans`` are the maximal removed runs as [start, end),
    ``kept`` the remaining bytes, which may cut a character. Each row is a document, so
    repeated rows repeat each other. Texts shorter than ``length`` stay. An empty table gives an empty result.
    """
    source = documents_of(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    runs = _runs(source)
    total = runs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def by_run(replies: DataFrame, name: str) -> DataFrame:
        """One row per run; a run has at most one reply per kind and bucket."""
        return replies.groupBy("run").agg(F.collect_list(F.struct("kind", "bucket", "codes")).alias(name))

    first = staged(_context_codes(_context_hashes(runs, buckets, length)), "suffix-codes")
    known = runs.join(by_run(first, "first"), "run", "left")
    second = staged(_verdicts(_blocks(known, buckets, length)), "suffix-verdicts")
    return _removed(known.join(by_run(second, "second"), "run", "left"), buckets, length, id_type)

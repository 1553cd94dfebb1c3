"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

Edit distance is counted in words. The CGK embedding walks over a word sequence: at step j it
puts out the current word and goes on to the next one if a random bit, fixed by step and word, is
set. Sequences at a small edit distance get walks that fall in step again, hence embeddings
at a small Hamming distance. LSH samples SYMBOLS steps of the embedding as a key; each repetition
has its own bits and steps, and half of them walk backward from a passage's end, so
that edits at one end leave the keys of the other. A window that starts at any word of a
document and shares a key with a benchmark item is verified by exact edit distance.

A walk reads about half of its steps in words, so keys see both halves of a passage only if it is short.
Items of 2 * PIECE words or more are therefore looked for by pieces of PIECE to 1.5 * PIECE words that
cover them. The edits of a passage are shared out over its pieces, so at least one piece is at no more
than the item's share of edits, wherever they are; a piece found leads to the whole item's verification.

Pieces come in classes of similar length, each with its own sampled steps, so a window is walked only
as far as the pieces it is compared with. Exact filters save work and lose nothing. Of any ``edits + SPARE``
words of a piece at least SPARE are left in a passage within the distance; so for each chunk of
text those words of each piece are taken that are rarest in the chunk, windows with fewer
than SPARE of them are not walked, and a piece that lacks more words than the distance
allows is not looked for. A walk stops when the steps sampled so far fit no piece. The stretch
that a piece of a cut item points to is not compared if it lacks too many of the item's words.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sigmatide.llm.common import KEY, documents_of, in_worker, only_rows, remembered, row_digest, row_key
from sigmatide.session import qualified, staged

MAX_EDITS = 0.2  # of an item's words
SYMBOLS, REPEATS = 3, 32  # sampled steps of a key, and keys; see the recall test
PIECE = 32  # least words of a piece of an item that is cut
CLASSES = (1, 2, 3, 4, 5, 6, 8, 11, 16, 23, 32, 45, 2 * PIECE)
BLOCK_ITEMS, BLOCK_CHARS = 4096, 4 << 20  # benchmark items searched for in one pass
CHUNK_BYTES = 2 << 20  # text searched at a time, at least one document
MANY_BLOCKS_CHUNK = 16 << 20  # the same where the blocks are too many to be kept
SPARE = 5  # words of an item that must be left of the rarest ones
FILTER_BITS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D
_FOREIGN = re.compile(r"[^\w\x00-\x7f]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def plain(text: str | None) -> bytes:
    """Lower case, with everything but letters and digits of any language between words."""
    text = (text or "").lower()
    return (text if text.isascii() else _FOREIGN.sub(" ", text)).encode("utf-8", "replace")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as needed so far."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
remembered("powers", _POWERS.clear)


def span_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes that are ``inside``."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * up[:len(raw)], out=sums[1:])
    return starts, ends, _mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word."""
    raw = np.frombuffer(text, np.uint8)
    return span_hashes(raw, _IS_WORD[raw])


@dataclass
class _Class:
    """Pieces of one length class."""

    steps: np.ndarray  # repetition x symbol
    places: np.ndarray  # piece x position: number of the word in the vocabulary, -1 behind the end
    edits: np.ndarray  # of each piece, at most
    window: int  # words that a passage of any of the pieces spans at most
    heads: list[list[np.ndarray]]  # repetition, symbol: which partial keys occur, by their top bits, eight in a byte
    keys: list[np.ndarray]  # repetition: sorted keys
    owners: list[np.ndarray]  # and the piece of each


def _partial(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _mix(key * _ODD + symbol)


def _has(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of these bits are set."""
    return (packed[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)


class ItemIndex:
    """LSH tables of a block of benchmark items; sent to the tasks, so blocks are bounded."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float = MAX_EDITS,
                 symbols: int = SYMBOLS, repeats: int = REPEATS, seed: int = 7):
        self.max_edits, self.repeats = max_edits, repeats
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 63, repeats, dtype=np.uint64)
        self.ids, self.words, hashes = [], [], []
        for item_id, text in items:
            raw = plain(text)
            starts, ends, found = word_spans(raw)
            if len(found):
                self.ids.append(item_id)
                self.words.append([raw[a:b] for a, b in zip(starts, ends)])
                hashes.append(found)
        # Words are numbered by the top bits of their hash; words that share these share the number.
        used = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]) >> np.uint64(44))
        self.n_words = len(used)
        self.numbers = np.full(1 << 20, self.n_words, np.int32)
        self.numbers[used] = np.arange(self.n_words)
        self.classes: list[_Class] = []
        cuts = [self._cuts(len(h)) for h in hashes]
        self.item = np.repeat(np.arange(len(cuts)), np.array([len(c) - 1 for c in cuts], np.int64))  # of each piece
        self.first = np.concatenate([np.empty(0, np.int64), *(c[:-1] for c in cuts)])
        self.last = np.concatenate([np.empty(0, np.int64), *(c[1:] for c in cuts)]) - 1
        pieces = [h[a:b] for h, c in zip(hashes, cuts) for a, b in zip(c, c[1:])]
        self.bags = {i: np.unique(self.numbers[h >> np.uint64(44)], return_counts=True)
                     for i, (h, c) in enumerate(zip(hashes, cuts)) if len(c) > 2}
        # Stretches of a cut item are compared once for all starts within so many words.
        self.grid = np.array([max(1, self.allowed(len(w))) if i in self.bags else 1
                              for i, w in enumerate(self.words)], np.int64)
        sizes = self.last - self.first + 1
        for low, high in zip(CLASSES, CLASSES[1:]):
            own = np.flatnonzero((sizes >= low) & (sizes < high))
            steps = np.stack([np.sort(rng.choice(low, min(symbols, low), replace=False))
                              for _ in range(repeats)])
            if len(own):
                self.classes.append(self._table(own, [pieces[i] for i in own], steps, low))

    @staticmethod
    def _cuts(words: int) -> np.ndarray:
        """Bounds of an item's pieces."""
        n = words // PIECE if words >= 2 * PIECE else 1
        return np.arange(n + 1) * words // n

    def allowed(self, words: int) -> int:
        return int(self.max_edits * words)

    def _table(self, own: np.ndarray, hashes: list[np.ndarray], steps: np.ndarray, low: int) -> _Class:
        heads, keys, owners = [], [], []
        sizes = np.array([len(h) for h in hashes])
        ahead, back = np.zeros((2, len(own), sizes.max()), np.uint64)
        places = np.full(ahead.shape, -1, np.int64)
        for n, words in enumerate(hashes):
            ahead[n, :len(words)], back[n, :len(words)] = words, words[::-1]
            places[n, :len(words)] = self.numbers[words >> np.uint64(44)]
        rows = np.arange(len(own))
        for r in range(self.repeats):
            levels = [np.zeros(1 << FILTER_BITS, bool) for _ in steps[r]]
            line = back if self.backward(r) else ahead
            pos, found = np.zeros(len(own), np.int64), np.zeros(len(own), np.uint64)
            for j in range(low):
                word = line[rows, pos]
                for level in np.flatnonzero(steps[r] == j):
                    found = _partial(found, word)
                    levels[level][found >> np.uint64(64 - FILTER_BITS)] = True
                pos += ((self.bits(word, r) >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            order = np.argsort(found, kind="stable")
            heads.append([np.packbits(level, bitorder="little") for level in levels])
            keys.append(found[order])
            owners.append(own[order])
        edits = np.array([self.allowed(n) for n in sizes.tolist()])
        return _Class(steps, places, edits, int(sizes.max() + edits.max()), heads, keys, owners)

    def backward(self, repeat: int) -> bool:
        return repeat % 2 == 1

    def bits(self, words: np.ndarray, repeat: int) -> np.ndarray:
        """64 random bits of each word for a repetition: bit j moves the walk at step j."""
        return _mix(words * _ODD ^ self.seeds[repeat])

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(place, piece, backward): windows that start, or end, at the place and share a key."""
        n = len(words)
        numbers = self.numbers[words >> np.uint64(44)]
        counts = np.bincount(numbers, minlength=self.n_words + 1)
        for c in self.classes:
            rare, needed = self._rare(c, counts)
            if not needed:
                continue
            own = rare[numbers]
            for backward in (False, True):
                line, total = words, np.concatenate(([0], np.cumsum(own)))
                if backward:
                    line, total = words[::-1], np.concatenate(([0], np.cumsum(own[::-1])))
                ends = np.minimum(np.arange(n) + c.window, n)
                alive = np.flatnonzero(total[ends] - total[:-1] >= needed)
                for r in range(int(backward), self.repeats, 2):
                    if not len(alive):
                        break
                    at, piece = self._walk(line, alive, c, r)
                    yield (n - 1 - at if backward else at), piece, backward

    def lacking(self, item: int, words: np.ndarray) -> int:
        """Words of a cut item that a stretch of text lacks; its edit distance is no less."""
        numbers, counts = self.bags[item]
        own = self.numbers[words >> np.uint64(44)]
        at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
        held = np.bincount(at[numbers[at] == own], minlength=len(numbers))
        return int(np.maximum(counts - held, 0).sum())

    def _rare(self, c: _Class, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """By number, the words to look for, and how many of them a passage has at least; zero if
        none of the pieces can occur."""
        found = np.where(c.places >= 0, counts[c.places], np.iinfo(np.int64).max)
        possible = np.flatnonzero((found == 0).sum(1) <= c.edits)
        rare = np.zeros(self.n_words + 1, bool)
        if not len(possible):
            return rare, 0
        rank = np.empty_like(found)
        np.put_along_axis(rank, found.argsort(1, kind="stable"), np.arange(found.shape[1])[None], 1)
        sizes = (c.places >= 0).sum(1)
        taken = np.minimum(c.edits + SPARE, sizes)
        chosen = rank[possible] < taken[possible, None]
        rare[c.places[possible][chosen]] = True
        return rare, int((taken - c.edits)[possible].min())

    def _walk(self, line: np.ndarray, starts: np.ndarray, c: _Class, r: int) -> tuple[np.ndarray, np.ndarray]:
        last = len(line) - 1
        pos, key = starts, np.zeros(len(starts), np.uint64)
        steps = c.steps[r]
        for j in range(int(steps[-1]) + 1):
            level = np.flatnonzero(steps == j)
            if len(level):
                key = _partial(key, line[pos])
                fits = _has(c.heads[r][level[0]], key >> np.uint64(64 - FILTER_BITS))
                starts, pos, key = starts[fits], pos[fits], key[fits]
            moves = (self.bits(line[pos], r) >> np.uint64(j)) & np.uint64(1)
            pos = np.minimum(pos + moves.astype(np.int64), last)
        low, high = (np.searchsorted(c.keys[r], key, side) for side in ("left", "right"))
        times = high - low
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(starts, times), c.owners[r][np.repeat(low, times) + within]


def nearest(item: list[bytes], text: list[bytes], anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance between the item and a stretch of the text, and
    where the first such stretch ends. The stretch starts anywhere, or at 0 if ``anchored``."""
    m = len(item)
    full, top = (1 << m) - 1, m - 1
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        equal = places.get(w, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(across | up)), up & across
        score += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = (plus << 1 | anchored) & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


def _matches(index: ItemIndex, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, distance, start byte, end byte): the best stretch of each item in each text."""
    joined = b"\n".join(texts)
    starts, ends, words = word_spans(joined)
    if not len(words):
        return
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_starts = np.cumsum(sizes) - sizes
    first = np.searchsorted(starts, text_starts)
    bounds = np.append(first, len(starts))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for at, piece, backward in index.candidates(words):
        of, item = np.searchsorted(bounds, at, "right") - 1, index.item[piece]
        cell = (at - (index.last if backward else index.first)[piece]) // index.grid[item]
        for place, i, text in zip(cell.tolist(), item.tolist(), of.tolist()):
            known = best.get((text, i))
            if known and known[0] == 0 or (place, i, text) in tried:
                continue
            tried.add((place, i, text))
            size, grid = len(index.words[i]), int(index.grid[i])
            edits = index.allowed(size)
            a = max(int(bounds[text]), place * grid - edits)
            b = min(int(bounds[text + 1]), (place + 1) * grid - 1 + size + edits)
            if i in index.bags and index.lacking(i, words[a:b]) > edits:
                continue
            window = [joined[s:e] for s, e in zip(starts[a:b], ends[a:b])]
            distance, end = nearest(index.words[i], window)
            if distance <= edits and (not known or distance < known[0]):
                back = nearest(index.words[i][::-1], window[:end][::-1], True)[1]
                best[text, i] = distance, a + end - back, a + end
    for (text, i), (distance, a, b) in best.items():
        if b > a:
            yield (text, i, distance, int(starts[a] - text_starts[text]),
                   int(ends[b - 1] - text_starts[text]))


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, max_edits: float, repeats: int,
             block_items: int) -> DataFrame:
    """block, index: an index for each block of items, built by the tasks that read the items, and written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[object, str | None]] = []
        size = 0

        def out() -> pa.RecordBatch:
            index = pickle.dumps(ItemIndex(block, max_edits, repeats=repeats), pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_arrays([pa.array([len(block)], pa.int64()), pa.array([index], pa.binary())],
                                              ["items", "index"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.append((item, text))
                size += len(text or "")
                if len(block) >= block_items or size >= BLOCK_CHARS:
                    yield out()
                    block, size = [], 0
        if block:
            yield out()

    return staged(documents_of(benchmark, id_col, text_col).mapInArrow(
        in_worker(run, "powers"), "items long, index binary"), "item-indexes")


def _index(file: str, row: int) -> ItemIndex:
    """A written index."""
    fs, path = pyarrow.fs.FileSystem.from_uri(file)
    return pickle.loads(pyarrow.parquet.read_table(path, columns=["index"], filesystem=fs).column("index")[row].as_py())


@lru_cache(maxsize=1)
def _reader(places: tuple[tuple[str, int], ...]) -> Callable[[str, int], ItemIndex]:
    """What reads the written indexes of a search; a worker keeps two of them, and none of an earlier search."""
    return lru_cache(maxsize=2)(_index)


remembered("indexes", _reader.cache_clear)


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_edits: float = MAX_EDITS,
    repeats: int = REPEATS,
    block_items: int | None = None,
) -> DataFrame:
    """doc_id, row, item_id, distance, item_words, passage: the nearest passage of an item in a document.

    A row for each document and item at an edit distance of at most ``max_edits`` of the item's
    words, found with the recall of the LSH (unchanged passages always). Words are runs of
    letters and digits in lower case. Null or wordless texts and items match nothing; items of
    under five words match unchanged only; equal items are each reported. ``row`` is a hash of the
    document's text: id and row tell documents apart where ids repeat; repeated rows are each
    reported. An empty table on either side gives an empty result.

    The benchmark is searched in blocks of bounded size. The tasks that read the items build the indexes and write them to
    the shared folder; one pass over the documents loads them in turn. The documents are not shuffled, the
    driver sees the names of the index files only.
    """
    source = documents_of(docs, id_col, text_col).select(
        "doc_id", row_digest(F.col("text")).alias("row"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema[item_id_col].dataType
    schema = (f"doc_id {id_type}, row long, item_id {item_type.simpleString()}, distance int, "
              "item_words int, passage string")
    indexes = _indexes(benchmark, item_id_col, item_text_col, max_edits, repeats,
                       block_items or BLOCK_ITEMS)
    counted = indexes.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    places = [(qualified(docs.sparkSession, r["file"]), k) for r in counted.orderBy("file").collect() for k in range(r["n"])]
    return _search(source, places, schema, to_arrow_type(item_type))


def _search(source: DataFrame, places: list[tuple[str, int]], schema: str, item_type: pa.DataType) -> DataFrame:
    # With more blocks than a worker keeps, more text is searched before the next one is loaded.
    chunk = CHUNK_BYTES if len(places) <= 2 else MANY_BLOCKS_CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(tuple(places))
        for batch in batches:
            rows, texts, size = [], [], 0
            for n in range(batch.num_rows + 1):
                if texts and (n == batch.num_rows or size >= chunk):
                    for place in places:
                        index = read(*place)
                        for text, i, distance, a, b in _matches(index, texts):
                            rows.append((n - len(texts) + text, index.ids[i], distance,
                                         len(index.words[i]), texts[text][a:b].decode("utf-8", "replace")))
                    texts, size = [], 0
                if n < batch.num_rows:
                    texts.append(plain(batch.column(2)[n].as_py()))
                    size += len(texts[-1])
            at, item, distance, words, passage = list(zip(*rows)) or [()] * 5
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(item, item_type),
                 pa.array(distance, pa.int32()), pa.array(words, pa.int32()),
                 pa.array(passage, pa.string())],
                ["doc_id", "row", "item_id", "distance", "item_words", "passage"])

    return source.mapInArrow(in_worker(run, "indexes", "powers"), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark passage was found, with all their columns."""
    found = staged(find_benchmark(docs, benchmark, id_col, text_col).select(
        row_key(F.col("doc_id"), F.col("row")).alias(KEY)), "contaminated")
    own = row_key(docs[id_col], row_digest(docs[text_col]))
    return only_rows(docs, own, found, drop=True).drop(KEY)

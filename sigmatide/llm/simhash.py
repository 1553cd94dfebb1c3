"""Near-duplicates by SimHash, found with anchor-point covering.

A fingerprint has 64 bits: blocks of 23, 23 and 18. Two fingerprints with at most
four differing bits differ by at most one bit in some block. The codewords of the perfect
Golay code of length 23 are the anchors of a block: each block value is within 3 bits (the
covering radius) of exactly one codeword, its home, and a value one bit away is within 4 bits
of that codeword. So each fingerprint is sent to every anchor within 4 bits of each block, about
16 copies, and each anchor compares the fingerprints at home with all it received. No pair
within the threshold is missed and none is left out.

Distinct fingerprints only are compared; documents of one fingerprint need no pair. An anchor
returns the links of its fingerprints as stars, one row a fingerprint, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sigmatide.llm.common import documents_of, in_worker, one_per_key, only_rows, row_digest, row_key
from sigmatide.llm.components import components
from sigmatide.session import staged

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
BLOCKS = ((0, 23), (23, 23), (46, 18))  # first bit and width
RADIUS = 3  # covering radius of the code
GENERATOR = 0b101011100011  # generator polynomial of the Golay code of length 23
LENGTH, CHECK_BITS = 23, 11
CELL_ROWS = 4096  # an anchor with more rows is compared through chunks of the other bits


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    lasts = ends[min(shingle_words, len(words)) - 1:].tolist()
    hashes = np.fromiter(
        (xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, lasts)), "<u8", n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row, fp): a hash of the text and its fingerprint as a signed long; null text has
    no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"", shingle_words) for t in batch.column(2)],
                           np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id", row_digest(F.col("text")).alias("row"), F.col("text").cast("binary")
    ).mapInArrow(in_worker(run), f"doc_id {id_type}, row long, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each value, as a polynomial, by the code's generator."""
    left = values.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - CHECK_BITS)), left)
    return left


def error_patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of at most ``reach`` bits by syndrome: a table of rows, -1 where there are fewer,
    and the weight of each pattern."""
    patterns = np.array([sum(1 << b for b in c) for w in range(reach + 1)
                         for c in combinations(range(LENGTH), w)], np.int64)
    syndrome = _syndromes(patterns)
    order = np.argsort(syndrome, kind="stable")
    counts = np.bincount(syndrome, minlength=1 << CHECK_BITS)
    table = np.full((1 << CHECK_BITS, counts.max()), -1, np.int64)
    row = syndrome[order]
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = patterns[order]
    return table, np.where(table >= 0, np.bitwise_count(table.astype(np.uint64)), LENGTH).astype(np.int64)


def _to_anchors(fps: DataFrame, spare: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor within the radius plus ``spare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weight = error_patterns(RADIUS + spare)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            unsigned = fp.view(np.uint64)
            for block, (low, width) in enumerate(BLOCKS):
                value = ((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
                syndrome = _syndromes(value)
                at, which = np.nonzero(table[syndrome] >= 0)
                anchor = value[at] ^ table[syndrome[at], which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor + (block << LENGTH)), pa.array(fp[at]),
                     pa.array(weight[syndrome[at], which] <= RADIUS)], ["anchor", "fp", "home"])

    return fps.mapInArrow(in_worker(run), "anchor long, fp long, home boolean")


def _linked(home: np.ndarray, every: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, every) within ``max_bits``, a few rows at a time."""
    step = max(1, (1 << 20) // max(1, len(every)))
    for at in range(0, len(home), step):
        near = np.bitwise_count(home[at:at + step, None] ^ every[None, :]) <= max_bits
        i, j = np.nonzero(near)
        yield i + at, j


def _stars(fp: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Links of one anchor as (fingerprint, a linked smaller index's fingerprint) rows."""
    every, own = fp, np.flatnonzero(home)
    label = np.arange(len(fp))
    while True:
        before = label.copy()
        for i, j in _linked(every[own], every, max_bits):
            h = own[i]
            least = np.minimum(label[h], label[j])
            np.minimum.at(label, h, least)
            np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return np.stack([fp[moved], fp[label[moved]]], 1)


def anchor_links(fp: np.ndarray, home: np.ndarray, max_bits: int) -> Iterator[np.ndarray]:
    """Links of one anchor's rows. Many rows are split by chunks of ``max_bits + 1`` bit ranges:
    two linked fingerprints agree in one of these, so each is compared there."""
    if len(fp) <= CELL_ROWS:
        if len(fp) > 1 and home.any():
            yield _stars(fp, home, max_bits)
        return
    width = -(-64 // (max_bits + 1))
    for low in range(0, 64, width):
        value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1 and home[group].any():
                yield _stars(fp[group], home[group], max_bits)


def _compare(anchored: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) links; the rows of an anchor follow each other in a partition."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.empty((0, 2), np.uint64), *found]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))
        for batch in _and_end(batches):
            if batch is None:
                anchor, fp, home = rest
                cuts = np.flatnonzero(np.diff(anchor)) + 1
                ends = [*cuts, len(anchor)] if len(anchor) else []
            else:
                new = (batch.column(0).to_numpy(zero_copy_only=False),
                       batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                       batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
                anchor, fp, home = (np.concatenate(x) for x in zip(rest, new))
                cuts = np.flatnonzero(np.diff(anchor)) + 1
                ends = cuts.tolist()
            found, start = [], 0
            for end in ends:
                if end - start > 1:
                    found += anchor_links(fp[start:end], home[start:end], max_bits)
                start = end
            rest = (anchor[start:], fp[start:], home[start:])
            yield out(found)

    return (
        anchored.repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(in_worker(run), "a long, b long")
    )


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: doc_id, row, fp (signed long), component, component_id.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of
    ``shingle_words`` words (the whole sequence if shorter) are hashed with their repeats, and a
    bit is set if more than half of the hashes have it. Null, empty and blank texts have
    fingerprint zero and link like any other. component_id is the smallest id reachable over
    links of at most ``max_bits`` bits (up to four), null if no member has an id; ``component`` is the
    least fingerprint so reached, and ``row`` a hash of the text. Repeated rows
    are returned as often as they come; an empty table gives an empty result.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("max_bits must be 0 to 4: the blocks cover no more")
    prints = staged(fingerprints(documents_of(docs, id_col, text_col), shingle_words), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    spare = max_bits // len(BLOCKS)
    links = staged(_compare(_to_anchors(distinct.select("fp"), spare), max_bits), "links")
    roots = components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(least, "root").select(
        F.col("fp").alias("of"), F.col("root").alias("component"), "component_id")
    return prints.join(known, prints["fp"] == known["of"]).select(
        "doc_id", "row", "fp", "component", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: the smallest id.

    Where that id repeats, one of its rows stays; a component without ids keeps one row.
    """
    found = simhash_dedup(docs, id_col, text_col, shingle_words, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.groupBy("component").agg(F.min(order).alias("best")).select("best.*")
    chosen = best.select(row_key(F.col("doc_id"), F.col("row")))
    return one_per_key(only_rows(docs, row_key(docs[id_col], row_digest(docs[text_col])), chosen))

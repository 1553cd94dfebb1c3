"""Source divergence audit by in-mapper stripes.

A task folds whole documents into hash stripes, term -> (document frequency, count per source),
and spills them as rows when they grow past a bound. Stripes are merged by (language, term);
the merged stripes, split by term into blocks of bounded size, directly give the divergences of
every pair of sources and of every source from its language.

All arithmetic is on integers: a term's share of a group is scaled to 10**9 by long division,
so counts may be as large as 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.session import staged

MIN_DOCUMENTS, TOP_TERMS = 10, 10
STRIPE_ENTRIES = 1 << 20  # entries that a task holds before it spills
ROWS_OUT = 1 << 15  # stripes in a batch that leaves a task
PIECE = 1 << 22  # bytes of a text split into terms at a time
BLOCK_TERMS = 1 << 12  # terms of a language in one block, about
TILE_SOURCES = 256  # sources in one tile, about: a block holds the counts of two tiles at most
#: The empty term is no term of any text; its stripe counts the documents of each source.
DOCUMENTS = b""

STRIPES = "lang string, term string, df long, sources array<string>, counts array<long>"
EVIDENCE = "lang string, part string, a string, b string, value long"

#: ASCII letters in lower case, all bytes of other code points, and a space for the rest.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a few megabytes of text at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # go on to the end of the term
            while end < len(text) and _TERM_BYTES[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


class Stripes:
    """Document frequencies per language and counts per (language, source), as hash tables."""

    def __init__(self) -> None:
        self.frequency: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        frequency, counts = self.frequency[lang], self.counts[lang][source]
        before = len(frequency) + len(counts)
        seen = {DOCUMENTS}
        counts[DOCUMENTS] += 1
        for terms in terms_of(text):
            counts.update(terms)
            seen.update(terms)
        frequency.update(iter(seen))
        self.entries += len(frequency) + len(counts) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows."""
        for lang, frequency in self.frequency.items():
            place = {term: i for i, term in enumerate(frequency)}
            sources = list(self.counts[lang])
            own = self.counts[lang].values()
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in own])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in own])
            source = np.repeat(np.arange(len(sources)), [len(c) for c in own])
            order = np.argsort(at, kind="stable")
            yield from _stripe_batches(
                pa.array([lang]).take(pa.array(np.zeros(len(place), np.int64))),
                pa.array(list(frequency), pa.binary()).cast(pa.string()),
                np.fromiter(frequency.values(), np.int64, len(frequency)),
                np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(place))))),
                pa.array(sources, pa.string()).take(pa.array(source[order])), count[order])


def _stripe_batches(lang: pa.Array, term: pa.Array, df: np.ndarray, offsets: np.ndarray, sources: pa.Array,
                    counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of stripe rows; the entries of row i lie at offsets[i] to offsets[i + 1]."""
    for i in range(0, len(df), ROWS_OUT):
        j = min(i + ROWS_OUT, len(df))
        low, high = offsets[i], offsets[j]
        cuts = pa.array((offsets[i:j + 1] - low).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [lang.slice(i, j - i), term.slice(i, j - i), pa.array(df[i:j]),
             pa.ListArray.from_arrays(cuts, sources.slice(low, high - low)),
             pa.ListArray.from_arrays(cuts, pa.array(counts[low:high]))],
            ["lang", "term", "df", "sources", "counts"])


def _fold(limit: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                stripes.add(lang, source, text.as_py())
                if stripes.entries > limit:
                    yield from stripes.batches()
                    stripes = Stripes()
        yield from stripes.batches()

    return fold


def _combined(rows: pa.Table) -> list[pa.RecordBatch]:
    """Sorted stripe rows with one row per (lang, term)."""
    rows = rows.combine_chunks()
    lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
    n = len(rows)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.or_(*(pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (lang, term))).to_numpy(False)
    first = np.flatnonzero(new)
    lists, counts = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
    coded = lists.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    of = np.repeat(np.cumsum(new) - 1, lists.value_lengths().to_numpy(False))
    key = of * width + coded.indices.to_numpy(False)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    summed = np.add.reduceat(counts.flatten().to_numpy(False)[order], cuts)
    key = key[cuts]
    at = pa.array(first)
    return list(_stripe_batches(
        lang.take(at), term.take(at), np.add.reduceat(rows.column("df").to_numpy(), first),
        np.searchsorted(key // width, np.arange(len(first) + 1)),
        coded.dictionary.take(pa.array(key % width)), summed))


def _merge(min_documents: int):
    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        common = pc.greater_equal(batch.column("df"), min_documents)
        return batch.filter(pc.or_(common, pc.equal(batch.column("term"), "")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch may go on in the next."""
        last = None
        for batch in batches:
            if not len(batch):
                continue
            merged = _combined(pa.Table.from_batches([batch] if last is None else [last, batch]))
            last = merged[-1].slice(len(merged[-1]) - 1)
            merged[-1] = merged[-1].slice(0, len(merged[-1]) - 1)
            yield from map(kept, merged)
        if last is not None:
            yield kept(last)

    return merge


def merged_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                   min_documents: int = MIN_DOCUMENTS, entries: int = STRIPE_ENTRIES) -> DataFrame:
    """One row per language and term of at least ``min_documents`` documents: lang, term, df, sources, counts.

    Null text, language and source are empty strings. Each row is a document. Every language also
    has the stripe of the empty term, with the documents of each source. An empty table has no rows.
    """
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in (
        (text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    partial = rows.mapInArrow(_fold(entries), STRIPES)
    return (partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_merge(min_documents), STRIPES))


def shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / size), exact, by long division in base 1000; 0 < count + 2 <= size."""
    rest, whole = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        whole = whole * 1000 + rest * 1000 // size
        rest = rest * 1000 % size
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of shares."""
    return (p - q) * (p - q) // (p + q)


def _top(values: np.ndarray, terms: list[str], n: int) -> list[tuple[int, str]]:
    """The n largest (value, term), ties by term; the terms come in order."""
    order = np.argsort(-values, kind="stable")[:n]
    return [(int(values[i]), terms[i]) for i in order]


def _emit(top_terms: int):
    def emit(group: pa.Table) -> pa.Table:
        """The evidence of one block: terms of a language, sources of one or two tiles."""
        group = group.sort_by([("kind", "ascending"), ("term", "ascending")])  # by UTF-8 bytes
        n = pc.sum(pc.equal(group.column("kind"), 0)).as_py()
        head, stripes = group.slice(0, n), group.slice(n)
        names = [x[0] for x in head.column("sources").to_pylist()]
        place = {name: i for i, name in enumerate(names)}
        totals = np.array([x[0] for x in head.column("counts").to_pylist()], np.int64)
        tile = head.column("tile").to_numpy()
        first = head.slice(0, 1).to_pylist()[0]
        vocabulary, lang_total, block = first["vocabulary"], first["lang_total"], first["block"]
        out: list[tuple[str, str, str, int]] = []
        size = totals + 2 * vocabulary
        none = shares(np.zeros(len(names), np.int64), size) if vocabulary else np.zeros(len(names), np.int64)

        terms = stripes.column("term").to_pylist()
        share = np.repeat(none[None, :], len(terms), 0)
        seen = np.zeros(share.shape, bool)
        lists, counts = stripes.column("sources").combine_chunks(), stripes.column("counts").combine_chunks()
        if len(terms):
            coded = lists.flatten().dictionary_encode()
            code = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(False)]
            row = np.repeat(np.arange(len(terms)), lists.value_lengths().to_numpy(False))
            share[row, code] = shares(counts.flatten().to_numpy(False), size[code])
            seen[row, code] = True

        across = first["i"] != first["j"]
        for s in range(len(names)):
            later = np.arange(s + 1, len(names))
            if across:  # pairs within a tile belong to the block of that tile alone
                later = np.flatnonzero((tile == first["j"]) & (tile[s] == first["i"]))
            if len(later):
                value = divergence(share[:, s:s + 1], share[:, later]).sum(0)
                if vocabulary:  # one block speaks for the terms that neither of its tiles holds
                    rest = divergence(none[s], none[later])
                    value += rest * ((vocabulary if block == 0 else 0) - len(terms))
                out += (("pair", names[s], names[t], int(v)) for t, v in zip(later, value))
            if not across and len(terms):
                whole = shares(stripes.column("total").to_numpy(), np.int64(lang_total + 2 * vocabulary))
                more = np.flatnonzero(seen[:, s] & (share[:, s] > whole))
                value = divergence(share[more, s], whole[more])
                out += (("term", names[s], term, v) for v, term in _top(value, [terms[i] for i in more], top_terms))
        part, a, b, value = zip(*out) if out else ((),) * 4
        return pa.table({
            "lang": pa.array([first["lang"]] * len(out), pa.string()), "part": pa.array(part, pa.string()),
            "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    return emit


def _tile(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.col("tiles"))


def _parts(number: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), number - 1)


def _pair(x: Column, y: Column) -> Column:
    return F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS,
                      tile_sources: int = TILE_SOURCES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ from each other and from their language.

    A language keeps its terms (runs of ASCII letters and of code points from U+0080, A-Z in lower case)
    of at least ``min_documents`` documents, each row being one. A kept term's share of a group is
    1 + floor(10**9 * (count + 2) / (N + 2 V)), with N all counts of kept terms there and V their number;
    the divergence of two shares is floor((p - q)**2 / (p + q)). Part ``pair``: item is each other source
    of the language, value the sum over all kept terms, 0 without any. Part ``term``: item is a kept term
    that the source holds with a larger share than the language, value its divergence from the
    language, the ``top_terms`` largest. Rank counts from 1 by value, largest first, then by item.

    Null text, language and source are empty strings; a source without terms takes part, a language with
    one source has no pairs. Repeated rows count as often as they are there. An empty table gives an
    empty result; other columns are ignored.

    A block holds about ``block_terms`` terms and two tiles of about ``tile_sources`` sources; a language
    with more terms or sources has more blocks, so no task holds a language, whatever its share of the rows.
    """
    stripes = staged(merged_stripes(docs, text_col, lang_col, source_col, min_documents), "stripes")
    is_term = F.col("term") != ""
    entry = F.explode(F.arrays_zip("sources", "counts")).alias("e")
    groups = staged(
        stripes.select("lang", is_term.alias("is_term"), entry)
        .groupBy("lang", F.col("e.sources").alias("source"))
        .agg(F.sum(F.when(F.col("is_term"), F.col("e.counts")).otherwise(0)).alias("total")), "stripe-groups")
    langs = staged(
        groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_sources"))
        .join(stripes.groupBy("lang").agg(F.count_if(is_term).alias("vocabulary")), "lang")
        .select("lang", "lang_total", "vocabulary",
                F.ceil(F.col("n_sources") / tile_sources).alias("tiles"),
                F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / block_terms)).alias("blocks")), "stripe-langs")

    heads = (
        groups.join(langs, "lang").withColumn("tile", _tile(F.col("source")))
        .withColumn("other", F.explode(_parts(F.col("tiles"))))
        .select("*", F.explode(_parts(F.col("blocks"))).alias("block"))
        .select("lang", F.inline(F.array(_pair(F.col("tile"), F.col("other")))), "block", F.lit(0).alias("kind"),
                F.lit("").alias("term"), F.col("total"), F.array("source").alias("sources"),
                F.array("total").alias("counts"), "tile", "vocabulary", "lang_total"))
    active = F.array_distinct(F.transform("sources", _tile))
    pairs = F.array_distinct(F.flatten(F.transform(
        active, lambda t: F.transform(_parts(F.col("tiles")), lambda o: _pair(t, o)))))

    def inside(source: Column) -> Column:
        return (_tile(source) == F.col("i")) | (_tile(source) == F.col("j"))

    own = F.filter(F.arrays_zip("sources", "counts"), lambda e: inside(e["sources"]))
    rows = (
        stripes.filter(is_term).join(langs, "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
        .withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
        .select("*", F.inline(pairs))
        .withColumn("own", F.when(F.col("tiles") == 1, F.arrays_zip("sources", "counts")).otherwise(own))
        .select("lang", "i", "j", "block", F.lit(1).alias("kind"), "term", "total",
                F.col("own.sources").alias("sources"), F.col("own.counts").alias("counts"),
                F.lit(None).cast("long").alias("tile"), "vocabulary", "lang_total"))
    evidence = heads.unionByName(rows).groupBy("lang", "i", "j", "block").applyInArrow(_emit(top_terms), EVIDENCE)

    def side(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("source"), F.col(y).alias("item"))

    both = F.when(F.col("part") == "pair", F.array(side("a", "b"), side("b", "a"))).otherwise(F.array(side("a", "b")))
    summed = evidence.groupBy("lang", "part", "a", "b").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return (
        summed.select("lang", "part", "value", F.inline(both)).withColumn("rank", place)
        .filter((F.col("part") == "pair") | (F.col("rank") <= top_terms))
        .select("lang", "source", "part", "item", "value", "rank"))

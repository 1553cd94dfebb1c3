"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in one grouped aggregation; the model is a matrix of
log-probabilities, languages by 2**HASH_BITS, which is broadcast. Its size depends on the
number of languages only. Texts are scored in groups: a sparse matrix of the n-grams that occur
in them is multiplied with the columns of these n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmatide.llm.common import documents_of

HASH_BITS, MAX_N = 16, 3
SMOOTHING = 0.5
MAX_LANGUAGES = 512  # the matrix is broadcast: 512 languages are 128 MB
SLICE = 1 << 18  # characters hashed at a time
GROUP_TEXTS = 64  # texts scored at a time
UNDETERMINED = "und"
_MIX = np.uint32(0x9E3779B1)


def gram_counts(text: str, hash_bits: int = HASH_BITS, max_n: int = MAX_N) -> np.ndarray:
    """Counts of the 1- to max_n-grams of code points by hash; the text in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(1 << hash_bits, np.int64)
    for at in range(0, len(points), SLICE):
        part = points[at:at + SLICE + max_n - 1]
        own = min(SLICE, len(points) - at)
        grams = np.zeros(len(part), np.uint32)
        for n in range(1, max_n + 1):
            grams = (grams[:len(part) - n + 1] * _MIX + part[n - 1:]) * np.uint32(2654435769 + 2 * n)
            grams ^= grams >> np.uint32(15)
            total += np.bincount(grams[:own] >> np.uint32(32 - hash_bits), minlength=1 << hash_bits)
    return total


def sparse_counts(texts: list[str], hash_bits: int = HASH_BITS, max_n: int = MAX_N) -> tuple[np.ndarray, ...]:
    """(row, gram, n) of the n-grams of each text, sorted by row and gram: gram_counts of all texts at once.

    Memory is that of len(texts) * 2**hash_bits counts and of the code points.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # points to the end of the text
    part = np.concatenate([*points, np.empty(0, "<u4")])
    total = np.zeros(len(texts) << hash_bits, np.int64)
    grams = np.zeros(len(part), np.uint32)
    for n in range(1, max_n + 1):
        if len(part) < n:
            break
        grams = (grams[:len(part) - n + 1] * _MIX + part[n - 1:]) * np.uint32(2654435769 + 2 * n)
        grams ^= grams >> np.uint32(15)
        own = np.flatnonzero(left[:len(grams)] >= n)
        key = (row[own] << hash_bits) + (grams[own] >> np.uint32(32 - hash_bits))
        total += np.bincount(key, minlength=len(total))
    some = np.flatnonzero(total)
    return some >> hash_bits, some & ((1 << hash_bits) - 1), total[some]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # languages x hashes
    prior: np.ndarray
    hash_bits: int
    max_n: int

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most probable language of each text and its posterior; ties go to the first by name."""
        found = [(UNDETERMINED, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        group, size = [], 0
        for i in known:
            group.append(i)
            size += len(texts[i])
            if len(group) == GROUP_TEXTS or size >= SLICE or i == known[-1]:
                for k, answer in zip(group, self._scored([texts[k] for k in group])):
                    found[k] = answer
                group, size = [], 0
        return found

    def _scored(self, texts: list[str]) -> list[tuple[str, float]]:
        """A sparse matrix of counts, texts by grams, times the log-probabilities; no text is empty."""
        if len(texts) == 1 and len(texts[0]) > SLICE:  # counted in slices
            counts = gram_counts(texts[0], self.hash_bits, self.max_n)
            gram = np.flatnonzero(counts)
            row, n = np.zeros(len(gram), np.int64), counts[gram]
        else:
            row, gram, n = sparse_counts(texts, self.hash_bits, self.max_n)
        starts = np.searchsorted(row, np.arange(len(texts)))
        scores = self.prior + np.add.reduceat(self.log_p[:, gram] * n, starts, axis=1).T
        best = scores.argmax(1)
        top = scores[np.arange(len(texts)), best]
        return [(self.languages[k], float(p)) for k, p in zip(best, 1 / np.exp(scores - top[:, None]).sum(1))]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
          hash_bits: int = HASH_BITS, max_n: int = MAX_N) -> LanguageModel:
    """Model of all rows with a language; null texts count as empty. No such rows: no language."""
    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).filter("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in sums:
                    sums[lang], docs_of[lang] = np.zeros(1 << hash_bits, np.int64), 0
                sums[lang] += gram_counts(text.as_py() or "", hash_bits, max_n)
                docs_of[lang] += 1
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(some) + 1), pa.string()),
                "gram": pa.array(np.append(some, -1), pa.int32()),
                "n": pa.array(np.append(total[some], docs_of[lang]), pa.int64())})

    counts = rows.mapInArrow(run, "lang string, gram int, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(
        F.collect_list(F.struct("gram", "n")).alias("grams"))  # at most 2**hash_bits + 1 entries
    found = by_lang.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not fit a broadcast")
    counted, prior = np.zeros((len(found), 1 << hash_bits)), np.zeros(len(found))
    for i, row in enumerate(found):
        for gram, n in row["grams"]:
            if gram < 0:
                prior[i] = n
            else:
                counted[i, gram] = n
    smooth = counted + SMOOTHING
    log_p = np.log(smooth / smooth.sum(1, keepdims=True)) if len(found) else counted
    return LanguageModel([r["lang"] for r in found], log_p,
                         np.log(prior / prior.sum()) if len(found) else prior, hash_bits, max_n)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior, 0 to 1) of every whole text; only the text is read.

    Null, empty and letterless texts are undetermined with score 0, as is everything if the
    model knows no language. Repeated rows are returned as often as they come.
    """
    source = documents_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside the held-out fold.

    A row is held out if crc32 of its id as text is 0 modulo ``folds``; a null id is held out.
    """
    def held_out(doc_id):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))

    model = train(docs.filter(~held_out(docs[id_col])), lang_col, text_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))

"""Quality classifier with hierarchical empirical Bayes over sites.

Each document gets evidence from its own text: a logistic model of its shape (is it prose?) and
one of the words that occur in it (is it toxic?), both fitted on labelled rows. Sites then
get posteriors by grouped aggregation: the mean evidence of a host, shrunk toward the global
mean, and of a path of the host, shrunk toward its host. The shrinkage is the spread
between sites, estimated from all of them, so that a site of few documents stays near its
parent. A document's final odds replace the global prior by the posterior of its path, computed
from the other documents of the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.llm.common import KEY, documents_of, in_worker, only_rows, row_digest, row_key
from sigmatide.llm.decontaminate import plain, span_hashes, word_spans
from sigmatide.session import staged

FIT_ROWS = 20_000  # labelled rows used by the fit at most, chosen by a hash of the id
WORD_PENALTY = 5e-4  # L1: most words carry no weight
SHAPE_PENALTY = 1e-4
THRESHOLD = 0.5
EDGE = 1e-4  # probabilities stay this far from 0 and 1
PRIOR_DOCS = (1.0, 1e6)  # range of the estimated shrinkage, in documents

CHUNK_CHARS = 1 << 20  # text looked at together, at least one document

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")  # in the form of decontaminate.plain
SHAPE = ("words", "no_letter", "symbol_runs", "upper", "repeats", "distinct", "top_word",
         "word_length", "digits", "long_words")


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


_SPACE = _bytes_in((9, 13), (32, 32))
_LOWER, _UPPER, _DIGIT = _bytes_in((97, 122)), _bytes_in((65, 90)), _bytes_in((48, 57))
_LETTER = _bytes_in((65, 90), (97, 122), (128, 255))  # all that is not ASCII counts as letters
_SYMBOL = _bytes_in((33, 47), (58, 64), (91, 96), (123, 126))


def shapes(texts: list[str]) -> np.ndarray:
    """Numbers about the form of each text, a row each; all zero without words.

    Words are runs without ASCII white space. All texts are looked at in one pass per number.
    """
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends, hashes = span_hashes(raw, ~_SPACE[raw])
    n_texts, of = len(texts), np.empty(0, np.int64)
    out = np.zeros((n_texts, len(SHAPE)))
    if not len(starts):
        return out
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    of = np.searchsorted(np.cumsum(sizes) - sizes, starts, "right") - 1

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[ends] - total[starts]

    symbol = _SYMBOL[raw]
    pairs = symbol.copy()
    pairs[1:] &= symbol[:-1]
    pairs[0] = False
    long = ends - starts
    order = np.lexsort((hashes, of))
    doc, word = of[order], hashes[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))
    times, doc = np.diff(heads, append=len(order)), doc[heads]
    firsts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    top = np.zeros(n_texts)
    top[doc[firsts]] = np.maximum.reduceat(times, firsts)
    again = np.append(False, (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1]))

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, n_texts) / safe

    n = np.bincount(of, minlength=n_texts)
    safe = np.maximum(n, 1)
    out[:] = np.stack([
        np.log1p(n) / 10, share(within(_LETTER[raw]) == 0), share(within(pairs) > 0),
        share((within(_UPPER[raw]) > 1) & (within(_LOWER[raw]) == 0)), share(again),
        np.bincount(doc, minlength=n_texts) / safe ** 0.8 / 4, np.where(n > 20, top / safe, 0.0),
        np.minimum(share(long), 40) / 10, share(within(_DIGIT[raw]) > 0), share(long > 24)], 1)
    out[n == 0] = 0
    return out


def word_set(text: str) -> set[str]:
    """The distinct words: runs of letters and digits in lower case."""
    return {w.decode("utf-8", "replace") for w in _WORD.findall(plain(text))}


class Vocabulary:
    """Finds which of a few words occur in texts."""

    def __init__(self, words: list[str]):
        hashes = np.array([word_spans(w.encode())[2][0] for w in words], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.some = np.zeros(1 << 20, bool)
        self.some[hashes >> np.uint64(44)] = True

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) pairs, each once."""
        parts = list(map(plain, texts))
        starts, _, hashes = word_spans(b"\n".join(parts))
        maybe = np.flatnonzero(self.some[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        sure = self.hashes[at] == hashes[maybe] if len(self.hashes) else np.zeros(0, bool)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        text = np.searchsorted(np.cumsum(sizes) - sizes, starts[maybe[sure]], "right") - 1
        pairs = np.unique(text * len(self.order) + self.order[at[sure]])
        return np.divmod(pairs, max(1, len(self.order)))


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, null ones as empty, a few at a time: as Python strings they would double a batch."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= CHUNK_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def fit_dense(x: np.ndarray, y: np.ndarray, penalty: float = SHAPE_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with a quadratic penalty, by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x1.shape[1], penalty * len(x))
    ridge[-1] = 1e-9
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge),
                               x1.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_sparse(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, width: int,
               penalty: float = WORD_PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with an absolute penalty.

    The features are 0 or 1: 1 at the (row, column) pairs. The fit runs on the features whose slope
    has exceeded the penalty so far, until no other feature's slope does: the optimum over all.
    """
    w, bias = np.zeros(width), 0.0
    active = np.zeros(width, bool)
    while True:
        own = active[columns]
        place = np.cumsum(active) - 1
        w[active], bias = _fit_active(rows[own], place[columns[own]], y, w[active], bias, penalty, rounds)
        odds = np.bincount(rows, w[columns], len(y)) + bias
        miss = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        slope = np.bincount(columns, miss[rows], width) / len(y)
        more = ~active & (np.abs(slope) > penalty)
        if not more.any():
            return w, bias
        active |= more


def _fit_active(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, start: np.ndarray, bias: float,
                penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """The fit on all the features given, by accelerated proximal steps from ``start``."""
    n, width = len(y), len(start)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[columns], n) + w[-1]

    def back(v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, v[rows], width), v.sum())

    # A step for each weight: the row sums of the Gram matrix bound its curvature, so that common
    # features do not slow the rare ones.
    rate = 4 * n / back(times(np.ones(width + 1)))
    cut = rate * penalty
    cut[-1] = 0
    w = look = np.append(start, bias)
    speed = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(look), -30, 30)))
        moved = look - rate * back(p - y) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - cut, 0)
        done = np.abs(new - look).max() < 1e-6
        faster = (1 + np.sqrt(1 + 4 * speed ** 2)) / 2
        look = new + (speed - 1) / faster * (new - w)
        w, speed = new, faster
        if done:
            break
    return w[:-1], float(w[-1])


@dataclass
class EvidenceModel:
    """Log-odds of being good by shape, and of being toxic by words; both linear."""

    shape_weights: np.ndarray
    shape_bias: float
    word_weights: dict[str, float]
    word_bias: float

    def good(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is of good quality and not toxic."""
        odds = shapes(texts) @ self.shape_weights + self.shape_bias
        toxic = np.full(len(texts), self.word_bias)
        if self.word_weights:
            if not hasattr(self, "_vocabulary"):
                self._vocabulary = Vocabulary(list(self.word_weights))
            text, word = self._vocabulary.places(texts)
            toxic += np.bincount(text, np.array(list(self.word_weights.values()))[word], len(texts))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) / (1 + np.exp(np.clip(toxic, -50, 50)))
        return np.clip(p, EDGE, 1 - EDGE)


def _model_words(rows: DataFrame) -> list[str]:
    """The words that the toxicity model may weigh; counted by a grouped aggregation.

    A word in at most WORD_PENALTY of the rows is left out: its slope never exceeds the penalty,
    so its weight is zero at the optimum. All others are weighed.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                own = pa.array(sorted(word_set(text.as_py())), pa.string())
                yield pa.RecordBatch.from_arrays([own], ["word"])

    least = WORD_PENALTY * rows.count()
    counts = rows.select("text").mapInArrow(in_worker(words), "word string").groupBy("word").count()
    return sorted(r["word"] for r in counts.filter(F.col("count") > least).select("word").collect())


def _features(rows: DataFrame, words: list[str]) -> DataFrame:
    """quality, toxic, shape, places (of the text's words in ``words``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words) if words else None
        for batch in batches:
            forms, found = [], []
            for some in _chunks(batch.column(0)):
                forms += shapes(some).tolist()
                own = [[] for _ in some]
                if vocabulary:
                    for text, word in zip(*(x.tolist() for x in vocabulary.places(some))):
                        own[text].append(word)
                found += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(forms, pa.list_(pa.float64())),
                 pa.array(found, pa.list_(pa.int32()))], ["quality", "toxic", "shape", "places"])

    return rows.select("text", "quality", "toxic").mapInArrow(
        in_worker(run, "powers"), "quality double, toxic double, shape array<double>, places array<int>")


def fit_evidence(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
                 id_col: str = "doc_id", text_col: str = "text") -> EvidenceModel:
    """Fit on at most ``fit_rows`` labelled documents, those with the smallest hash of the id.

    Rows without id or without a label take no part; repeated texts count once. A target of
    which only one class is labelled gives no evidence: without labels every document is good.
    Features are computed in tasks; the driver fits on ``fit_rows`` rows of ten numbers
    and the places of their distinct words, whatever the size of the corpus. The penalty
    chooses the words.
    """
    texts = documents_of(docs, id_col, text_col)
    chosen = (
        labels.select("doc_id", "quality", "toxic")
        .filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .join(texts.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    joined = chosen.join(texts, "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("quality").cast("double"), F.col("toxic").cast("double"))
    rows = staged(joined.groupBy(F.sha2("text", 256)).agg(
        F.min("text").alias("text"), F.min("quality").alias("quality"),
        F.max("toxic").alias("toxic")).select("text", "quality", "toxic"), "labelled")
    by_words = rows.filter("toxic IS NOT NULL")
    two = rows.agg(F.countDistinct("quality"), F.countDistinct("toxic")).first()
    words = _model_words(by_words) if two[1] == 2 else []
    data = _features(rows, words).toArrow()  # as numbers: Python objects would take ten times the memory
    quality, toxic = (data.column(c).to_numpy() for c in ("quality", "toxic"))
    weights, bias = np.zeros(len(SHAPE)), 50.0
    if two[0] == 2:
        own = ~np.isnan(quality)
        forms = data.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, len(SHAPE))
        weights, bias = fit_dense(forms[own], quality[own])
    weighted, word_bias = {}, -50.0
    if words:
        own, places = ~np.isnan(toxic), data.column("places").combine_chunks()
        sizes = places.value_lengths().to_numpy()
        found, word_bias = fit_sparse(np.repeat(np.cumsum(own) - 1, sizes)[np.repeat(own, sizes)],
                                      places.flatten().to_numpy()[np.repeat(own, sizes)],
                                      toxic[own], len(words))
        weighted = {w: float(v) for w, v in zip(words, found) if v}
    return EvidenceModel(weights, bias, weighted, word_bias)


def site_of(source: Column, section: Column) -> tuple[Column, Column]:
    """Host and path of a source: of a URL its host and first path segment, else the source
    itself and the section. Missing ones are the empty string."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(bare, "[/?#]")
    path = F.coalesce(F.get(parts, F.lit(1)), section, F.lit(""))
    return F.lower(F.get(parts, F.lit(0))), path


def _logit(p: Column) -> Column:
    safe = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(safe / (1 - safe))


@dataclass
class Priors:
    """Global mean, and how many documents the parent's mean is worth for a host and a path."""

    mean: float
    host: float
    path: float


def site_totals(evidence: DataFrame) -> DataFrame:
    """host, path, n, total, squares, host_n, host_total; ``evidence`` has host, path, p."""
    paths = evidence.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"),
        F.sum(F.col("p") * F.col("p")).alias("squares"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    return paths.join(hosts, "host")


def site_priors(sites: DataFrame) -> Priors:
    """Method of moments: the variance between documents over the variance between sites."""
    n = F.sum("n")
    whole = sites.agg((F.sum("total") / n).alias("mean"), (F.sum("squares") / n).alias("square")).first()
    if whole["mean"] is None:
        return Priors(0.5, 1.0, 1.0)
    host_mean, path_mean = F.col("host_total") / F.col("host_n"), F.col("total") / F.col("n")
    spread = sites.agg(
        (F.sum(F.col("n") * (host_mean - whole["mean"]) ** 2) / n).alias("host"),
        (F.sum(F.col("n") * (path_mean - host_mean) ** 2) / n).alias("path")).first()
    low, high = PRIOR_DOCS
    within = max(0.0, whole["square"] - whole["mean"] ** 2)

    def worth(between: float) -> float:
        return min(high, max(low, within / between if between > 0 else high))

    return Priors(whole["mean"], worth(spread["host"]), worth(spread["path"]))


def score(docs: DataFrame, model: EvidenceModel, id_col: str = "doc_id", text_col: str = "text",
          host: Column | None = None, path: Column | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, host, path, evidence, path_posterior, score, kept: one row per row of ``docs``.

    Host and path come from ``source`` and ``lang`` unless given. Null texts, hosts and paths count as empty. A
    document alone on its site gets the prior of its host, alone on its host
    the global mean. kept: score of at least ``threshold``. Repeated rows are scored alike;
    ``row`` is a hash of the text.
    """
    if host is None:
        host, path = site_of(docs["source"], docs["lang"])
    host, path = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (host, path))
    rows = docs.select(docs[id_col].alias("doc_id"), row_digest(docs[text_col]).alias("row"),
                       host.alias("host"), path.alias("path"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.empty(0), *map(shared.value.good, _chunks(batch.column(4)))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(p, pa.float64())], ["doc_id", "row", "host", "path", "p"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    evidence = staged(rows.mapInArrow(
        in_worker(run, "powers"), f"doc_id {id_type}, row long, host string, path string, p double"), "evidence")
    sites = staged(site_totals(evidence), "sites")
    prior = site_priors(sites)
    joined = evidence.join(sites, ["host", "path"])
    host_mean = ((prior.host * prior.mean + F.col("host_total") - F.col("p"))
                 / (prior.host + F.col("host_n") - 1))
    path_mean = (prior.path * host_mean + F.col("total") - F.col("p")) / (prior.path + F.col("n") - 1)
    odds = _logit(F.col("p")) + _logit(path_mean) - _logit(F.lit(prior.mean))
    final = 1 / (1 + F.exp(-odds))
    return joined.select(
        "doc_id", "row", "host", "path", F.col("p").alias("evidence"), path_mean.alias("path_posterior"),
        final.alias("score"), (final >= threshold).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The documents that the classifier, fitted on the labels of these documents, keeps."""
    found = score(docs, fit_evidence(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    rejected = staged(found.filter("NOT kept").select(
        row_key(F.col("doc_id"), F.col("row")).alias(KEY)), "rejected")
    return only_rows(docs, row_key(docs[id_col], row_digest(docs[text_col])), rejected, drop=True).drop(KEY)

"""Token ids of texts, by a public tokenizer file and the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from sigmatide.llm.common import remembered, trim

# Encoded pieces that a worker remembers, in each of two generations; only speed depends on it.
WORDS_KEPT = 200_000
IDS_KEPT = 16  # ids of the pieces of a generation, in multiples of their number
LONG_KEPT = 4 << 20  # characters of long pieces
GROUP = 2 << 20  # bytes of texts encoded together
JOINED = 4096  # new pieces joined for one call
SHORT = 64  # characters of a piece that is joined with others at most
MARKS = ".,;:!?*&%$#@+=~^/_-()[]{}\""  # cut off the word that they end, up to TAIL of them
TAIL = 4
LETTERS = pa.array([chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªº"])
# A space after white space: there a tokenizer that keeps white space may not be cut.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
NO_CUT = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "] "
# Always a token boundary: the end of a word before a space.
CUT = re.compile(r"(?<=\S)(?= )")


class _Memory:
    """Ids of pieces, one after the other; a piece has the slot of its place in the order of learning."""

    def __init__(self):
        self.keys = pa.array([], pa.string())  # the pieces, each with the space before it
        self.long = 0  # characters of pieces that were not joined
        self.n = self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)  # one more than pieces: the last is where the ids end
        self.ids = np.empty(1 << 14, "<u4")

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Slots of distinct pieces, -1 for those that are not known.

        The known ones are looked up in a table of the given ones, which is the smaller to build.
        """
        at = pc.index_in(self.keys, value_set=pieces)
        slots = np.full(len(pieces), -1, np.int64)
        slots[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(False))
        return slots

    def add(self, pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of new pieces with these ids, which end there."""
        n, used = self.n + len(ends), self.used + len(ids)
        while n >= len(self.starts):
            self.starts = np.append(self.starts, np.empty_like(self.starts))
        while used > len(self.ids):
            self.ids = np.append(self.ids, np.empty_like(self.ids))
        self.starts[self.n + 1:n + 1], self.ids[self.used:used] = self.used + ends, ids
        self.keys = pa.concat_arrays([self.keys, pieces])
        slots = np.arange(self.n, n)
        self.n, self.used = n, used
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces joined, and where each of them ends."""
        starts = self.starts[slots]
        sizes = self.starts[slots + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    A tokenizer never joins a word with the space after it, so a text is cut before
    the spaces that follow a word, the pieces are encoded by the library, and their ids are
    joined: the same ids as for the text at once, in memory that a piece bounds. Texts are cut, and
    their distinct pieces found and looked up, by Arrow. New pieces are encoded many at a
    time, joined by their own spaces and told apart by the tokens that begin with a space, or by the offsets of the
    tokens where spaces leave no trace. Marks that end a new piece after a Latin letter are cut off where the
    tokenizer splits there, so that a word is encoded once, whatever marks follow it. Strings of special tokens within a text are
    ordinary text or, with ``special``, these tokens, as in the library's plain call; they hold
    no space and none of these marks, so the cuts stay right.
    """

    def __init__(self, path: str, special: bool = False, group: int | None = None, kept: int | None = None):
        self.group, self.kept = group, kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids begin with the byte of a space, in the byte alphabet.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        if not self.spaced[self.tokenizer.encode(" a", add_special_tokens=False).ids[:1]].all():
            self.spaced[:] = False  # this tokenizer drops spaces
        #: Which ids end a word, where the vocabulary tells.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ended = np.zeros_like(self.spaced)
        if suffix:
            self.ended[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        #: Marks before which this tokenizer splits a word, and that no special token holds.
        added = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(m for m in MARKS if m not in added and self._splits("ab", m))
        #: Whether it splits before a line break that follows a word or a mark.
        self.breaks = "\n" not in added and all(self._splits("ab" + m, "\nab") for m in ["", *self.marks])
        self.memory, self.old = _Memory(), _Memory()

    def _splits(self, left: str, right: str) -> bool:
        """Whether words of the two together are those of each."""
        splitter = self.tokenizer.pre_tokenizer
        if splitter is None:
            return False
        together, *each = ([word for word, _ in splitter.pre_tokenize_str(x)] for x in (left + right, left, right))
        return together == sum(each, [])

    def __call__(self, texts: Sequence[str] | pa.Array) -> Iterator[bytes]:
        """Ids of each text; a null text is empty."""
        trim()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + (self.group or GROUP))))
            yield from self._group(texts.slice(at, end - at))
            at = end
        trim()

    def _pieces(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Pieces of the texts, without the space before them, and the row of each text there."""
        odd = pc.match_substring_regex(texts, NO_CUT)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " "), np.arange(len(texts))
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        cut = []
        for text in texts.filter(odd).to_pylist():
            head, *rest = CUT.split(text)
            cut.append([head, *(p[1:] for p in rest)])
        order = np.argsort(odd.to_numpy(False), kind="stable")
        rows = np.empty(len(texts), np.int64)
        rows[order] = np.arange(len(texts))
        return pa.concat_arrays([plain, pa.array(cut, plain.type)]), rows

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        kept = self.kept or WORDS_KEPT
        if self.memory.long > LONG_KEPT:
            self.memory, self.old = _Memory(), _Memory()
        if self.memory.n > kept or self.memory.used > IDS_KEPT * kept:
            self.memory, self.old = _Memory(), self.memory
        lists, rows = self._pieces(texts)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        head = np.zeros(len(flat), bool)
        head[offsets[:-1]] = True
        rest = flat.filter(pa.array(~head)).dictionary_encode()
        later = pc.binary_join_element_wise("", rest.dictionary.cast(pa.string()), " ")
        found = self._slots(pa.concat_arrays([later, flat.filter(pa.array(head)).cast(pa.string())]))
        slots = np.empty(len(flat), np.int64)
        slots[~head] = found[:len(later)][rest.indices.to_numpy(False)]
        slots[head] = found[len(later):]
        ids, ends = self.memory.gather(slots)
        ends = np.append(0, ends)
        low, high = ends[offsets[:-1]][rows].tolist(), ends[offsets[1:]][rows].tolist()
        for a, b in zip(low, high):
            yield ids[a:b].tobytes()

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """Slots of pieces, which may repeat; each has the space before it."""
        pieces = pieces.dictionary_encode()
        distinct, memory = pieces.dictionary, self.memory
        slots = memory.find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new) and self.old.n:
            at = self.old.find(distinct.take(new))
            known = new[at >= 0]
            slots[known] = memory.add(distinct.take(known), *self.old.gather(at[at >= 0]))
            new = new[at < 0]
        if len(new):
            slots[new] = self._learn(distinct.take(new))
        return slots[pieces.indices.to_numpy(False)]

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Slots of distinct new pieces; those that can be cut again get the ids of their parts."""
        size = pc.utf8_length(pieces)
        short = pc.less_equal(size, SHORT + 1)
        cut, parts = self._cut(pieces.filter(short))
        rows = np.flatnonzero(short.to_numpy(False))[cut]
        slots, whole = np.empty(len(pieces), np.int64), np.ones(len(pieces), bool)
        whole[rows] = False
        inner = pc.utf8_slice_codeunits(pieces, 1)
        joined = whole & _all(short, pc.greater(size, 1), pc.starts_with(pieces, " "),
                              pc.equal(pc.utf8_trim(inner, "".join(WHITE)), inner))
        # Pieces of one word tell their ends, and stay apart from the others.
        alpha = joined & (pc.utf8_is_alpha(inner).to_numpy(False) if self.ended.any() else False)
        for some, words in ((np.flatnonzero(alpha), True), (np.flatnonzero(joined & ~alpha), False)):
            for at in range(0, len(some), JOINED):
                block = some[at:at + JOINED]
                slots[block] = self._encode(pieces.take(block), words)
        alone = np.flatnonzero(whole & ~joined)
        if len(alone):
            found = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces.take(alone).to_pylist()]
            slots[alone] = self.memory.add(pieces.take(alone), np.fromiter(chain.from_iterable(found), "<u4"),
                                           np.cumsum(list(map(len, found))))
            sizes = size.to_numpy(False)[alone]
            self.memory.long += int(sizes[sizes > SHORT + 1].sum())
        if len(rows):
            found = self._slots(parts).reshape(-1, len(rows))
            ids, ends = self.memory.gather(found.T.ravel())
            slots[rows] = self.memory.add(pieces.take(rows), ids, ends[len(found) - 1::len(found)])
        return slots

    def _cut(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Which of these can be cut, and their parts: all first ones, all second ones
        and so on, empty where there is none.

        The parts are the words before and from a single line break, and the marks at the end of each; they cannot be cut again.
        """
        lines = pc.split_pattern(pieces, "\n", max_splits=1)
        offsets = lines.offsets.to_numpy()
        head, tail = (lines.values.take(pa.array(at)) for at in (offsets[:-1], offsets[1:] - 1))
        ends = pa.concat_arrays([LETTERS, pa.array(list(self.marks), pa.string())])
        broken = pa.array(_all(pc.equal(pc.count_substring(pieces, "\n"), 1),
                               pc.is_in(pc.utf8_slice_codeunits(head, -1), value_set=ends)) & self.breaks)
        sides = [pc.if_else(broken, head, pieces), pc.if_else(broken, pc.binary_join_element_wise("", tail, "\n"), "")]
        parts, cut = [], broken
        for side in sides:
            stem = pc.utf8_rtrim(side, self.marks)
            marks = pc.subtract(pc.utf8_length(side), pc.utf8_length(stem))
            marked = pa.array(_all(pc.greater(marks, 0), pc.less_equal(marks, TAIL),
                                   pc.is_in(pc.utf8_slice_codeunits(stem, -1), value_set=LETTERS)))
            tails = [pa.scalar(""), *(pc.utf8_slice_codeunits(side, -n) for n in range(1, TAIL + 1))]
            parts += [pc.if_else(marked, stem, side), pc.choose(pc.if_else(marked, marks, 0), *tails)]
            cut = pc.or_(cut, marked)
        return np.flatnonzero(cut.to_numpy(False)), pa.concat_arrays([part.filter(cut) for part in parts])

    def _encode(self, pieces: pa.Array, words: bool) -> np.ndarray:
        """Slots of pieces of a space and no other white space at their ends; ``words``: of one word each."""
        n, joined = len(pieces), "".join(pieces.to_pylist())
        ids, starts = np.empty(0, "<u4"), np.empty(0, np.int64)
        if words or self.spaced.any():
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            # A piece has one space at least and one word at least, so equal numbers mean one each.
            starts = np.flatnonzero(self.spaced[ids])
            if words and len(ids) and self.ended[ids[-1]]:
                starts = np.append(0, np.flatnonzero(self.ended[ids])[:-1] + 1)
        if len(starts) != n or starts[0] != 0:
            found = self.tokenizer.encode(joined, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(pc.utf8_length(pieces).to_numpy(False).astype(np.int64))
            tokens = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(ids))
            starts = np.append(0, np.searchsorted(tokens, ends)[:-1])
        return self.memory.add(pieces, ids, np.append(starts[1:], len(ids)))


def _all(*conditions: pa.Array) -> np.ndarray:
    """Where all of the conditions hold."""
    return reduce(pc.and_, conditions).to_numpy(False)


@lru_cache(maxsize=4)
def encoder(path: str, group: int | None = None, kept: int | None = None) -> Encoder:
    """One encoder for each file in a worker, with the ids of the library's plain call."""
    return Encoder(path, special=True, group=group, kept=kept)


remembered("encoders", encoder.cache_clear)

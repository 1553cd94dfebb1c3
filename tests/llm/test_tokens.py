"""Token ids, packing and token files: exact round trips and the contract's figures."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigmatide.llm import packing as pk
from sigmatide.llm import queries as qu
from sigmatide.llm import token_files as tf
from sigmatide.llm.tokens import Encoder

from .conftest import ODD

FILES = [qu.PACK_TOKENIZER, qu.FILE_TOKENIZER]


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


STRANGE = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n\nb", "don't we'll  it's", "\t\tx \ty\x1c z", "x\xa0 y　 z",
           "á ́b é", "Σίσυφος ΣΑΣ", "🙂 🙂🙂  🙂", "<|endoftext|> and <|startoftext|>!", "\r\n \r\n", "1 22 333  4444",
           "!!! ??? ...  --", "a  b\x85 c", "​ ​", "日本 語  テキスト", "ŉ ﬁ Å ½"]


@pytest.mark.parametrize("path", FILES)
def test_pieces_give_the_ids_of_the_whole(path):
    encode, plain, rng = Encoder(path), whole(path), random.Random(4)
    alphabet = "ab Z9.'\n\t  é🙂 \x1c-!  "
    texts = STRANGE + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, encode(texts)):
        assert ids == plain(text).tobytes(), repr(text)


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    from sigmatide.llm import tokens

    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    monkeypatch.setattr(tokens, "GROUP", 10)
    monkeypatch.setattr(tokens, "JOINED", 7)
    encode, plain = Encoder(FILES[0]), whole(FILES[0])
    texts = [f"some words {i} are here again" for i in range(20)] + STRANGE
    assert list(encode(texts)) == [plain(t).tobytes() for t in texts]


class Counting:
    """A tokenizer that counts the characters that it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode(self, text, **options):
        self.characters += len(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("path", FILES)
def test_a_word_is_encoded_once_whatever_mark_or_line_follows(path):
    encode, plain, rng = Encoder(path), whole(path), random.Random(8)
    words = ["".join(rng.choices("abcdefghijé", k=12)) for _ in range(300)]
    texts = ["start " + " ".join(word + mark for word in words) 
             for mark in ["", *".,;:!?", "\nx", ".\nx", "\nx,", "***", "%%%", ".***", ')."']]
    encode.tokenizer = counting = Counting(encode.tokenizer)
    assert list(encode(texts)) == [plain(t).tobytes() for t in texts]
    assert counting.characters < 1.1 * sum(len(w) + 1 for w in words)


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("path", FILES)
def test_words_with_marks_and_lines_keep_their_ids(path, special):
    encode, rng = Encoder(path, special=special), random.Random(9)
    plain = plain_call(path) if special else whole(path)
    parts = ["a", "It", "'s", "é", "e\u0301", "1", " ", " ", " ", "\n", "\r", "\t", *".,;:!?", "...", "\"", "<|endoftext|>", "Σ",
             "***", "%", "-", "_", "/", "#", "(", ")", "ß", "Ê", "ª", "²", "\x85", "\u0307", "|"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)]
    for text, ids in zip(texts, encode(texts)):
        assert ids == plain(text).tobytes(), repr(text)


def test_a_remembered_piece_takes_little_memory():
    encode, rng = Encoder(FILES[0]), random.Random(10)
    list(encode([" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(50_000))]))
    memory = encode.memory
    assert memory.n > 49_000
    assert memory.keys.nbytes + memory.starts.nbytes + memory.ids.nbytes < 100 * memory.n


def plain_call(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", FILES)
def test_special_tokens_get_the_ids_of_the_plain_call(path):
    encode, plain, rng = Encoder(path, special=True), plain_call(path), random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "a", "word", "!", "é", "<|", "|>", "'s"]
    texts = STRANGE + ["a <|endoftext|> b"] + [
        "".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, encode(texts)):
        assert ids == plain(text).tobytes(), repr(text)


def test_operators_give_the_ids_of_the_plain_call(make):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y z", "plain words"]
    docs = make([(i, t, "en") for i, t in enumerate(texts)])
    pieces, _ = pk.pack_documents(docs, qu.PACK_TOKENIZER, capacity=64)
    want = {i: np.append(plain_call(qu.PACK_TOKENIZER)(t), 0).astype("<u4").tobytes() for i, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["ids"]) for r in pieces.collect()} == want
    files, manifest = tf.write_token_files(docs, qu.FILE_TOKENIZER)
    want = {i: np.append(plain_call(qu.FILE_TOKENIZER)(t), 1).astype("<u4").tobytes() for i, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["ids"]) for r in tf.read_token_files(files, manifest).collect()} == want


# Packing

@pytest.mark.parametrize("seed", range(8))
def test_pack_lengths(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
    patterns = pk.pack_lengths(counts, 64)
    used = defaultdict(int)
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= 64
        for length in pattern:
            used[length] += n
    assert used == counts


def test_longest_first_onto_the_emptiest_pack():
    # the second 5 fits the emptiest pack, the one of the first 5; a 4 fits the one of the 6
    assert pk.pack_lengths({6: 1, 5: 2, 4: 3}, 10) == [((5, 5), 1), ((6, 4), 1), ((4, 4), 1)]
    assert pk.pack_lengths({7: 1, 6: 1, 3: 1}, 10) == [((6, 3), 1), ((7,), 1)]


def check_packed(pieces, documents):
    cover, places = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = documents[r["doc_id"]]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids)
        cover[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, ids in documents.items():
        at = 0
        for start, length in sorted(cover[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(places) == list(range(len(places)))
    return len(places)


def test_packing_query(spark, small, texts):
    encode = whole(qu.PACK_TOKENIZER)
    documents = {i: np.append(encode(t), 0).astype("<u4") for i, t in texts.items()}
    n = check_packed(qu.op8_packing_spfhp(spark, small).collect(), documents)
    assert n * 1024 < 1.02 * sum(map(len, documents.values())) + 1024


def test_packing_of_odd_rows(odd, empty):
    pieces, placed = pk.pack_documents(odd, qu.PACK_TOKENIZER)
    rows = placed.collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == pieces.count()
    assert pk.pack_documents(empty, qu.PACK_TOKENIZER)[1].count() == 0


def test_sequences_hold_the_pieces_ids(odd):
    pieces, _ = pk.pack_documents(odd.filter("doc_id > 1"), qu.PACK_TOKENIZER, capacity=64)
    packed = pk.pack(pieces, 64)
    whole_rows = {r["sequence_id"]: r for r in pk.sequences(packed, 64, pad_id=7).collect()}
    for r in packed.collect():
        ids = np.frombuffer(whole_rows[r["sequence_id"]]["ids"], "<u4")
        assert len(ids) == 64
        assert ids[r["offset"]:r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
        assert (ids[whole_rows[r["sequence_id"]]["n_ids"]:] == 7).all()


def test_lengths_beyond_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 70)], "doc_id long, length long"), 64)


# Files

class Kept(io.BytesIO):
    def close(self):
        pass


def test_file_round_trip_and_seeking():
    rng = np.random.default_rng(0)
    documents = [(None, rng.integers(0, 9, 3)), (1, rng.integers(0, 49408, 5)), (1, rng.integers(0, 9, 700_000)),
                 (2, np.array([1])), (9, rng.integers(0, 2**32, 100))]
    sink = Kept()
    writer = tf.FileWriter(sink)
    for doc_id, ids in documents:
        writer.add(doc_id, ids.astype("<u4").tobytes())
    writer.close()
    content = sink.getvalue()
    reader = tf.FileReader(sink, len(content))
    assert reader.index["doc_id"].tolist() == [0, 1, 1, 2, 9] and reader.index["known"].tolist() == [0, 1, 1, 1, 1]
    assert len(reader.table) == 7  # the long one takes three frames
    for row, (_, ids) in enumerate(documents):
        assert reader.document(row) == ids.astype("<u4").tobytes()
    # any reader of the format can decompress it all
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True)
    assert stream.read() == b"".join(ids.astype("<u4").tobytes() for _, ids in documents)


def test_only_frames_asked_for_are_read_and_checked():
    sink = Kept()
    writer = tf.FileWriter(sink)
    for i in range(3):
        writer.add(i, np.arange(1000, dtype="<u4").tobytes())
    writer.close()
    damaged = bytearray(sink.getvalue())
    frame = tf.FileReader(sink, len(damaged)).ends[1]
    damaged[frame - 20] ^= 255
    reader = tf.FileReader(io.BytesIO(bytes(damaged)), len(damaged))
    assert len(reader.document(0)) == len(reader.document(2)) == 4000
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.document(1)


def test_token_files_query(spark, small, texts):
    encode, at, want = whole(qu.FILE_TOKENIZER), 0, []
    for i in sorted(texts):
        ids = np.append(encode(texts[i]), 1).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])
                 for r in qu.op10_token_files(spark, small).collect())
    assert got == want


def test_token_files_of_odd_rows(odd, empty):
    folder, manifest = tf.write_token_files(odd, qu.FILE_TOKENIZER)
    rows = sorted(tf.read_token_files(folder, manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted((r[0] for r in ODD), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r["start"] == at and bytes(r["ids"])[-4:] == b"\x01\0\0\0"
        at += r["n_tokens"]
    some = tf.read_token_files(folder, manifest, [1, 5, 77]).collect()
    assert sorted(r["doc_id"] for r in some) == [1, 1, 1, 5]
    folder, manifest = tf.write_token_files(empty, qu.FILE_TOKENIZER)
    assert tf.read_token_files(folder, manifest).count() == 0


def test_attempts_that_failed_are_in_no_manifest(spark, odd):
    folder, manifest = tf.write_token_files(odd, qu.FILE_TOKENIZER)
    fs, path = tf._place(folder)
    with fs.open_output_stream(f"{path}/000000-left-over.ids.zst", compression=None) as f:
        f.write(b"half a file")
    assert tf.read_token_files(folder, manifest).count() == len(ODD)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(ODD)


def test_pieces_keep_their_columns(spark):
    pieces = spark.range(50).selectExpr("id % 7 + 1 length", "id + 900 rank", "3 total", "id __x", "id part")
    rows = pk.pack(pieces, 16).collect()
    assert sorted((r["rank"], r["total"], r["__x"], r["part"]) for r in rows) == [(i + 900, 3, i, i) for i in range(50)]
    with pytest.raises(ValueError):
        pk.pack(pieces.withColumn("offset", pieces["part"]), 16)


def test_files_are_read_by_many_tasks_and_pruned_by_id(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('text of ', id) text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, manifest = tf.write_token_files(docs.repartition(8), qu.FILE_TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 4 and folder.startswith("file:///")
    found = tf.read_token_files(folder, manifest)
    assert found.rdd.getNumPartitions() == min(manifest.count(), 8)
    assert found.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    ranges = sorted((r["first_id"], r["last_id"]) for r in manifest.collect())
    assert ranges[0][0] == 0 and ranges[-1][1] == 399 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    some = tf.read_token_files(folder, manifest, [0, 17, 399, 4000])
    whole = {r["doc_id"]: r for r in found.collect()}
    assert sorted(some.collect()) == sorted(whole[i] for i in (0, 17, 399))


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        tf.write_token_files(spark.createDataFrame([("a", "x")], "doc_id string, text string"), qu.FILE_TOKENIZER)

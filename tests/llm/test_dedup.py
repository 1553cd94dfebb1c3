"""Exact, near, line and passage duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigmatide.llm import components as co
from sigmatide.llm import exact_dedup as ex
from sigmatide.llm import line_dedup as li
from sigmatide.llm import queries as qu
from sigmatide.llm import simhash as si
from sigmatide.llm import suffix_dedup as su

from .conftest import LONG, ODD

WHITE = r"[\x20\x09-\x0D]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Exact

def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(WHITE, " ", text or "")].append(doc_id)
    out = []
    for doc_id, text in rows:
        normal = re.sub(WHITE, " ", text or "")
        known = [i for i in groups[normal] if i is not None]
        keep = min(known) if known else None
        out.append((doc_id, keep, len(groups[normal]), doc_id == keep,
                    hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_of_odd_rows(odd):
    got = sorted(map(tuple, ex.exact_dedup(odd).collect()), key=str)
    assert got == exact_by_hand([r[:2] for r in ODD])


def test_exact_dedup_compares_content_under_one_digest(odd):
    weak = ex.exact_dedup(odd, salts=2, digest=lambda text: F.lit("same"))
    assert sorted(map(tuple, weak.collect()), key=str) == exact_by_hand([r[:2] for r in ODD])


def test_exact_dedup_of_nothing(empty):
    assert ex.exact_dedup(empty).count() == 0
    assert ex.drop_exact_copies(empty).columns == empty.columns


def test_exact_copies_leave_one_row_each(odd):
    left = ex.drop_exact_copies(odd)
    assert left.columns == odd.columns
    texts = Counter(re.sub(WHITE, " ", r["text"] or "") for r in left.collect())
    assert set(texts.values()) == {1} and len(texts) == len({re.sub(WHITE, " ", r[1] or "") for r in ODD})


def test_exact_dedup_is_native(odd):
    plan = ex.exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_dedup_query(spark, small, texts):
    got = sorted(map(tuple, qu.op6_exact_dedup(spark, small).collect()), key=str)
    assert got == exact_by_hand(list(texts.items()))


# Components

@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)],
                                   [(5, 5), (9, 2), (2, 9), (7, 2), (-4, 30)], []])
def test_components(spark, links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in co.components(frame).collect()} == want


# SimHash

def fingerprint_by_hand(text, words=4):
    found = [w for w in re.split(WHITE, lowered(text)) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_hand(prints, max_bits=4):
    """Smallest id reachable, per row."""
    n, parent = len(prints), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for i in range(n):
        if prints[i][0] is not None:
            least[find(i)] = min(least.get(find(i), prints[i][0]), prints[i][0])
    return [least.get(find(i)) for i in range(n)]


@pytest.mark.parametrize("text", ["", "   ", "One", "a b c", "A b C d", "x y z w v u", "é È ü Über straße", "a\x0bb\x1cc\xa0d e f"])
def test_fingerprint(text):
    assert si.fingerprint(text.encode()) == fingerprint_by_hand(text)


def test_every_pair_in_reach_meets_at_an_anchor():
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints):
        bits = rng.sample(range(64), rng.randint(0, 4))
        prints.add(p ^ sum(1 << b for b in bits))
    table, weight = si.error_patterns(si.RADIUS + 1)
    at = defaultdict(list)
    for p in prints:
        for block, (low, width) in enumerate(si.BLOCKS):
            value = np.array([p >> low & (1 << width) - 1])
            s = int(si._syndromes(value)[0])
            homes = 0
            for pattern, w in zip(table[s], weight[s]):
                if pattern >= 0:
                    at[block, int(value[0] ^ pattern)].append((p, w <= si.RADIUS))
                    homes += w <= si.RADIUS
            assert homes == 1  # the code is perfect
    linked = {frozenset((x, y)) for rows in at.values() for x, home in rows if home for y, _ in rows
              if x != y and (x ^ y).bit_count() <= 4}
    every = {frozenset((x, y)) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= 4}
    assert linked == every


def test_an_anchor_with_many_rows_is_split_without_loss(monkeypatch):
    monkeypatch.setattr(si, "CELL_ROWS", 8)
    rng = random.Random(2)
    fp = [rng.getrandbits(64) for _ in range(40)]
    fp += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in fp]
    rows = np.array(sorted(set(fp)), np.uint64)
    links = np.concatenate(list(si.anchor_links(rows, np.ones(len(rows), bool), 4)))
    ids = {int(p): i for i, p in enumerate(rows)}
    want = near_by_hand([(i, int(p)) for i, p in enumerate(rows)])
    parent = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            low = min(parent[ids[int(a)]], parent[ids[int(b)]])
            parent[ids[int(a)]] = parent[ids[int(b)]] = low
    assert parent == want


def test_simhash_of_odd_rows(odd):
    got = si.simhash_dedup(odd).collect()
    prints = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got]
    assert sorted(prints, key=str) == sorted(((r[0], fingerprint_by_hand(r[1] or "")) for r in ODD), key=str)
    assert [r["component_id"] for r in got] == near_by_hand(prints)


def test_simhash_query(spark, small, texts):
    got = {r["doc_id"]: r for r in qu.op2_simhash_anchors(spark, small).collect()}
    prints = [(i, fingerprint_by_hand(t)) for i, t in sorted(texts.items())]
    assert all(got[i]["fingerprint"] == f"{p:016x}" for i, p in prints)
    assert [got[i]["component_id"] for i, _ in prints] == near_by_hand(prints)


def test_near_copies_leave_one_document_each(odd, empty):
    assert si.simhash_dedup(empty).count() == 0
    assert si.drop_near_copies(empty).count() == 0
    left = si.drop_near_copies(odd)
    assert left.columns == odd.columns
    prints = {fingerprint_by_hand(r[1] or "") for r in ODD}
    assert left.count() == len(set(near_by_hand([(i, p) for i, p in enumerate(prints)])))


# Lines

def lines_by_hand(rows, min_length=40, min_documents=5):
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k] |= {doc_id} - {None}
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = holders[key(line)]
            keeper = max(own, default=None)
            if not (len(key(line)) >= min_length and len(own) >= min_documents
                    and keeper is not None and doc_id != keeper):
                kept.append(line)
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


COMMON = "this very line is found in a great number of documents"
LINES = [(i, f"{COMMON.upper()}\nown {i}\n\t {COMMON}  \r", None) for i in range(1, 7)] + [
    (6, f"{COMMON}\nsame id", None), (None, COMMON, None), (8, "short\nshort\n", None), (9, None, None),
    (10, "", None), (11, "é" * 39 + "\n" + "é" * 40, None)] + [(i, "é" * 40, None) for i in range(12, 17)]


def test_line_dedup(make):
    got = sorted(map(tuple, li.line_dedup(make(LINES)).collect()), key=str)
    assert got == lines_by_hand([r[:2] for r in LINES])


def test_lines_of_repeated_ids_count_once(spark, make, tmp_path):
    """Four rows of one document and one of another are two documents; the query's SQL agrees."""
    import duckdb

    rows = [(1, f"{COMMON}\nown {i}", None) for i in range(4)] + [(2, COMMON, None), (None, COMMON, None)]
    assert all(r["n_dropped"] == 0 for r in li.line_dedup(make(rows)).collect())
    rows += [(i, COMMON, None) for i in (3, 4, 5, 5)]
    got = sorted(map(tuple, li.line_dedup(make(rows)).collect()), key=str)
    assert got == lines_by_hand([r[:2] for r in rows]) and sum(r[3] for r in got) == 8
    plain = [(i, f"{COMMON}\nx {i}" if i != 3 else "short", None, None) for i in range(1, 8)]
    spark.createDataFrame(plain, "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({qu.OP3_SQL})").fetchall()
    found = qu.op3_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_line_dedup_of_odd_rows(odd, empty):
    got = sorted(map(tuple, li.line_dedup(odd, min_length=0, min_documents=2).collect()), key=str)
    assert got == lines_by_hand([r[:2] for r in ODD], 0, 2)
    assert li.line_dedup(empty).count() == 0


# Passages

def passages_by_hand(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    starts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0)).reshape(-1, 2).tolist()
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), edges, kept))
    return sorted(out, key=str)


def passage_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s))
            parts += [s if rng.random() < 0.5 else s[:cut] + rng.choice("xyz") + s[cut:],
                      " ".join(rng.choices(words, k=rng.randint(0, 40)))]
        rows.append((i, " ".join(parts), None))
    return rows + [(40, "ab" * 400, None), (41, "z" * 700, None), (42, rows[3][1], None), (43, None, None),
                   (43, "", None), (None, rows[5][1][50:], None), (44, "q" * 199, None), (45, "q" * 199, None)]


@pytest.mark.parametrize("length", [200, 90, 40])
def test_suffix_dedup(make, length):
    rows = passage_rows(length)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["spans"], bytes(r["kept"]))
                  for r in su.suffix_dedup(make(rows), length=length).collect()), key=str)
    assert got == passages_by_hand([r[:2] for r in rows], length)


def passages(docs, length=200):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["spans"], bytes(r["kept"]))
                   for r in su.suffix_dedup(docs, length=length).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_suffix_dedup_tells_zero_bytes_apart(make, parts):
    """Passages that differ only in the number of zero bytes behind or before them, in one run and in several."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh", k=230))
    rows = [(i, f"{i} " + "\0" * (i % 3) + passage + "\0" * (1 + i % 5), None) for i in range(80)]
    assert passages(make(rows).repartition(parts)) == passages_by_hand([r[:2] for r in rows], 200)


@pytest.mark.parametrize("parts", [1, 4])
def test_suffix_dedup_of_control_characters(make, parts):
    rng = random.Random(12)
    texts = ["".join(map(chr, rng.choices([0, 1, 2, 3], [0.7, 0.1, 0.1, 0.1], k=rng.randint(0, 400)))) for _ in range(40)]
    texts += [t[a:] + "\0" * a + u for t, u, a in zip(texts, texts[7:], range(0, 60, 2))] + ["\0" * 333]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    for length in (200, 60):
        assert passages(make(rows).repartition(parts), length) == passages_by_hand([r[:2] for r in rows], length)


def test_contexts_under_one_hash_are_told_apart_by_content():
    rng = np.random.default_rng(5)
    data = np.frombuffer(bytes(rng.integers(97, 100, 3000).tolist()) * 2, np.uint8)
    sizes = np.array([3000, 3000])
    plain = su.contexts(data, sizes, 90)
    weak = su.Contexts(plain.gram * 0, plain.hash * 0, plain.first, plain.count, plain.anchor)
    a, b = (su.distinct(c, 3, data.tobytes(), 90) for c in (plain, weak))
    assert len(a.often) == len(b.often) > 50 and sorted(a.often) == sorted(b.often)
    pairs = {(x, y) for x, y in zip(a.which.tolist(), b.which.tolist())}
    assert len(pairs) == len(a.often)  # the same contexts are together


def test_suffix_dedup_cuts_long_texts_into_segments(make, monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    rows = [(1, text, None), (2, "head " + text[1_040_000:1_060_000] + " tail", None), (3, text[2_999_900:], None)]
    got = {r["doc_id"]: (r["n_removed"], r["spans"]) for r in su.suffix_dedup(make(rows)).collect()}
    assert got == {1: (20_000, [[1_040_000, 1_060_000]]), 2: (20_000, [[5, 20_005]]), 3: (0, [])}


def test_suffix_dedup_of_nothing(empty):
    assert su.suffix_dedup(empty).count() == 0


def test_merge_puts_out_sorted_strings_and_shared_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 9))})
                for _ in range(rng.randint(1, 9))]
        out = list(su.merge([su.front_decode(su.front_code(r)) for r in runs]))
        strings = [x[0] for x in out]
        assert strings == sorted(s for r in runs for s in r)
        assert all(n == su.shared_prefix(a, b, 0) for a, (b, n, _) in zip(strings, out[1:]))


def test_known_prefixes_are_not_compared_again(monkeypatch):
    looked = []
    plain = su.shared_prefix
    monkeypatch.setattr(su, "shared_prefix", lambda a, b, n: looked.append(n) or plain(a, b, n))
    runs = [sorted(b"p" * 50 + bytes([c, d]) for c in range(97 + i, 117, 3)) for i in range(3) for d in (i,)]
    list(su.merge([su.front_decode(su.front_code(r)) for r in runs]))
    assert sum(n < 50 for n in looked) <= len(runs)

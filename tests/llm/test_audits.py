"""Source divergence, filter interactions and chats against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigmatide.llm import chat_format as ch
from sigmatide.llm import divergence as di
from sigmatide.llm import filter_audit as fa
from sigmatide.llm import queries as qu

from .conftest import LONG, ODD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Source divergence

def divergence_by_hand(rows, min_documents, top):
    """rows of (text, lang, source)"""
    rows = [(TERM.findall(lowered(t or "")), lang or "", s or "") for t, lang, s in rows]
    frequency, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, lang, source in rows:
        groups[lang].add(source)
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in frequency[lang].items() if n >= min_documents]

        def share(count):
            size = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // size for t in kept}

        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: share(counts[lang, s]) for s in sources}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def mixed_rows(n, seed):
    """Texts of few terms in few languages and sources; one source holds a third, one language has rare terms only."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÄRGER", "ärger", "x1y", "naïve", "don't", "日本", "z", "\x00nul", "€", "Q"]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else f"s{rng.randrange(7)}"
        text = " ".join(rng.choices(words, [2 ** -(k % 5) for k in range(len(words))], k=rng.randrange(12)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), source))
    return rows + [(f"only{chr(97 + i)}", "rare", f"r{i % 3}") for i in range(6)] + [("alone", "single", "one")] * 12


@pytest.mark.parametrize("tiles, block", [(256, 4096), (2, 3)])
def test_divergence_in_tiles_and_blocks(spark, make, tiles, block):
    rows = mixed_rows(400, 3)
    docs = make([(i, *r) for i, r in enumerate(rows)]).repartition(5)
    got = di.source_divergence(docs, min_documents=10, top_terms=3, tile_sources=tiles, block_terms=block)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 10, 3)


def test_divergence_of_a_language_without_kept_terms(spark, make):
    rows = [("one", "xx", "a"), ("two", "xx", "b"), (None, "xx", None)]
    got = sorted(map(tuple, di.source_divergence(make([(i, *r) for i, r in enumerate(rows)])).collect()))
    assert got == divergence_by_hand(rows, 10, 10) and len(got) == 6 and {r[4] for r in got} == {0}


def test_divergence_of_odd_rows(odd):
    got = di.source_divergence(odd, min_documents=1)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand([(r + (None,) * 4)[1:4] for r in ODD], 1, 10)


def test_divergence_of_nothing(empty):
    found = di.source_divergence(empty)
    assert found.count() == 0 and found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_stripes_that_spill_are_merged(spark, make):
    """A task that may hold two entries spills after each document."""
    rows = mixed_rows(200, 5)
    docs = make([(i, *r) for i, r in enumerate(rows)]).coalesce(2)

    def stripes(entries):
        return {(r["lang"], r["term"]): (r["df"], sorted(zip(r["sources"], r["counts"])))
                for r in di.merged_stripes(docs, min_documents=3, entries=entries).collect()}

    spilled = stripes(2)
    assert spilled == stripes(1 << 20)
    by_hand = Counter()
    for text, lang, _ in rows:
        by_hand.update({(lang or "", t) for t in TERM.findall(lowered(text or ""))})
    assert {k: v[0] for k, v in spilled.items() if k[1]} == {k: n for k, n in by_hand.items() if n >= 3}
    assert spilled["en", ""][0] == sum(r[1] == "en" for r in rows)


def test_terms_of_a_long_text_do_not_break(monkeypatch):
    text = "Über " * 50 + LONG[:2000] + "é" * 300
    monkeypatch.setattr(di, "PIECE", 7)
    got = [t.decode() for part in di.terms_of(text.encode()) for t in part]
    assert got == TERM.findall(lowered(text))


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(2000):
        size = rng.randrange(3, 9 * 10**15)
        count = rng.randrange(0, size - 1)
        assert int(di.shares(np.array([count]), np.array([size]))[0]) == 1 + 10**9 * (count + 2) // size


def test_blocks_bound_a_task(spark, make):
    """A hot language is dealt over several blocks, and no block holds many more terms than asked for."""
    docs = make([(i, " ".join("t" + "abcdefghij"[j % 10] + "abcdefghij"[j // 10] for j in range(100)), "en", f"s{i % 3}")
                 for i in range(12)])
    plan = di.source_divergence(docs, block_terms=10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning(lang" in plan and "block" in plan


# Filter interactions

def audit_by_hand(docs, labels):
    """docs of (doc_id, text, source); labels of (doc_id, quality, toxic)"""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        rows[source or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, own in rows.items():
        shapley, found = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = [r for r in own if not r[0] & set(order[:k])]
                here = [r for r in before if letter in r[0]]
                shapley[letter] += len(here)
                found.append([part, "".join(order), k + 1, letter, len(before) - len(here), len(here),
                              sum(letter in r[0] for r in own) - len(here), sum(r[0] == {letter} for r in own),
                              sum(r[1] for r in here), sum(r[2] for r in here)])
        out += [(*r, shapley[r[3]]) for r in found]
    return sorted(out)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part int, n int, good string")


def audited(spark, docs, labels):
    rows = fa.filter_interactions(docs, labels_of(spark, [(*r, 7, 7, "x") for r in labels]))
    return sorted(map(tuple, rows.collect()))


def test_filters_in_every_order(spark, make):
    rng = random.Random(9)
    texts = ["a " * 250, " ".join(f"w{i}" for i in range(260)), " ".join(f"W{i}" for i in range(260)), "short # one",
             " ".join(f"w{i}" for i in range(300)) + " *", "\x0b x\x0cy\x1c "]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)]
    assert audited(spark, make([(i, t, "en", s) for i, t, s in docs]), labels) == audit_by_hand(docs, labels)


def test_filters_of_odd_rows(spark, odd):
    """Repeated ids and labels, null ids, null and blank texts, a long text."""
    labels = [(1, 1, 0), (1, 0, None), (1, 1, 1), (2, None, None), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, odd, labels) == audit_by_hand([(r + (None,) * 4)[:2] + ((r + (None,) * 4)[3],) for r in ODD], labels)


def test_filters_of_a_hot_text(spark, make):
    docs = [(i, "same text" if i % 3 else f"text {i} &", f"s{i % 40}") for i in range(600)]
    assert audited(spark, make([(i, t, "en", s) for i, t, s in docs]), [(5, 1, 1)]) == audit_by_hand(docs, [(5, 1, 1)])


def test_filters_of_nothing(spark, empty):
    found = fa.filter_interactions(empty, labels_of(spark, []))
    assert found.count() == 0 and "shapley" in found.columns


def test_other_filters_and_the_row_limit(spark, make):
    """Own failure conditions; the session's limit on rows of a recursion is left as it was."""
    before = spark.conf.get(fa.ROW_LIMIT)
    spark.conf.set(fa.ROW_LIMIT, "10")
    try:
        docs = make([(i, t, "en", f"s{i}") for i, t in enumerate(["x y", "x", "", "x"])])
        found = fa.filter_interactions(docs, labels_of(spark, []), {"S": F.size("words") < 2, "X": F.col("text").contains("x")})
        rows = {(r["part"], r["filter_order"], r["step"]): (r["removed"], r["redundant"]) for r in found.collect()}
        assert len(rows) == 4 * 6 * 3
        assert rows["s3", "SXE", 2] == (0, 1) and rows["s3", "EXS", 1] == (1, 0) and rows["s0", "SXE", 2] == (1, 0)
        assert spark.conf.get(fa.ROW_LIMIT) == "10"
    finally:
        spark.conf.set(fa.ROW_LIMIT, before)


# Chats

NASTY = st.lists(st.sampled_from([*"\\#</turn>:as \n€𝄞", "###", "</turn>", "### assistant: "]), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NASTY), NASTY), max_size=5))
def test_rendered_turns_read_back(turns):
    formatted, loss = ch.render(turns)
    assert ch.read_turns(formatted) == turns
    assert [ch.unescaped(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("</turn>\n") >= len(turns)


def test_broken_output_is_refused():
    with pytest.raises(ValueError):
        ch.read_turns("### user: never ends")


EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, at long, length long"


def chats(spark, rows, parts=3):
    events = spark.createDataFrame([(r + (None,) * 8)[:8] for r in rows], EVENTS).withColumns(
        {"pos": F.lit(1), "event": F.lit("x"), "formatted": F.lit(0)}).repartition(parts)
    return {r["conv_id"]: r for r in ch.format_chats(events).collect()}


def turns(row):
    return ch.read_turns(row["formatted"])


def test_events_fold_into_messages(spark):
    rows = [
        (1, 1, "open", 1, "user"), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"),
        (1, 4, "open", 2, "assistant"), (1, 5, "delta", 2, None, "bad answer"), (1, 6, "open", 3, "user"),
        (1, 7, "delta", 3, None, "what?"), (1, 8, "regenerate", 2), (1, 9, "delta", 2, None, "good 𝄞nswer"),
        (1, 10, "edit", 2, None, "a", 5, 1), (1, 11, "delta", 3, None, "withdrawn"), (1, 12, "edit", 1, None, "Hi"),
        (1, 13, "open", 4, "user"), (1, 14, "edit", 4, None, "end", 99, 5), (1, 15, "edit", 4, None, "START ", -3, 0)]
    random.Random(4).shuffle(rows)
    row = chats(spark, rows)[1]
    assert turns(row) == [("user", "Hi"), ("assistant", "good answer"), ("user", "START end")]
    assert (row["n_turns"], row["n_events"], row["n_ignored"]) == (3, 15, 1)
    assert [row["formatted"][s["start"]:s["end"]] for s in row["loss"]] == ["good answer"]


def test_odd_events(spark):
    """Events delivered twice, equal numbers, unknown kinds, null ids, kinds, roles and texts, no messages."""
    rows = [(1, 1, "open", 1, "assistant"), (1, 1, "open", 1, "assistant"), (1, 2, "delta", 1, None, "x"),
            (1, 2, "delta", 1, None, "x"), (1, 3, "delta", 1, None, "b"), (1, 3, "delta", 1, None, "a"),
            (2, 1, "close", 1), (2, 2, None, None), (2, 3, "delta", 9, None, "x"),
            (None, None, "open", 1), (None, 1, "delta", 1), (None, 2, "open", None, "user"), (3, 1, "open", 1, "user"),
            (3, 2, "open", 1, "assistant")]
    got = chats(spark, rows)
    assert turns(got[1]) == [("assistant", "xa")] and got[1]["n_events"] == 3
    assert got[2]["formatted"] == "" and got[2]["n_ignored"] == 3 and got[2]["n_turns"] == 0
    assert turns(got[None]) == [("", "")] and got[None]["n_ignored"] == 1
    assert turns(got[3]) == [("user", "")] and got[3]["n_ignored"] == 1


def test_no_events(spark):
    assert chats(spark, []) == {}


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(3) for c in ("seq", "kind", "message", "pieces", "pos", "event", "length")})


def test_a_log_folds_into_the_messages_it_came_from(spark):
    rng = random.Random(6)
    rows = [(i % 5 if i % 11 else None, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "a:b"]),
             rng.choice([None, "", "𝄞" * 9, LONG[:rng.randrange(3000)], "\\### x</turn>", "twin"])) for i in range(120)]
    rows += [(77, i, "user" if i % 2 else "assistant", f"turn {i} " * 40) for i in range(60)]  # a third in one chat
    log = ch.log_of(messages(spark, rows), piece=64)
    assert {"open", "delta", "edit", "regenerate"} == {r["kind"] for r in log.select("kind").distinct().collect()}
    back = ch.read_back(ch.format_chats(log))
    by_hand = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_hand[conv].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in back.collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == by_hand
    for conv, own in by_hand.items():
        assert got[conv]["loss_text"] == "".join(t for role, t in own if role == "assistant")


def test_a_long_text_streams_in_deltas(spark):
    log = ch.log_of(messages(spark, [(1, 0, "assistant", LONG)]))
    assert log.count() >= len(LONG) // ch.PIECE
    row = ch.read_back(ch.format_chats(log)).collect()[0]
    assert row["loss_text"] == LONG


def test_chat_query_on_the_planted_conversation(spark, small):
    row = qu.op13_chat_formatting(spark, small).filter("conv_id = -7").collect()[0]
    text = "\\### Assistant: </turn> ok"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(text))
    assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()

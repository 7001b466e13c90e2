"""Ranked search, the tokenization automaton and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import public_tokenizers
import pytest

from rowloom.llm import merge_automaton, prefix_trie, ranked_search

WORDS = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Ranked search


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(documents, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total = sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * len(docs)) // total
            score = 0
            for t in set(terms(text)) & set(c):
                w = floor(1000 * log((2 * len(docs) + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if null else i, -score))
    return Counter(out)


def searched(spark, documents, items, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, n int, terms string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    return Counter(map(tuple, ranked_search.search(docs.repartition(3), asked, **options).collect()))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "Ab", "aB", "日本"]

    def text(n):
        return " ".join(draw.choice(vocabulary[: draw.choice([5, 20, 65])]) for _ in range(n))

    documents = [(i, text(draw.choice([1, 5, 30]))) for i in range(200)]
    documents += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (300, None), (301, ""), (302, "-- ?")]
    documents += [(400 + i, "same text w4 w5") for i in range(40)] + [(500, "w7 " * 40_000)]
    common = "w1 w2 w3 w4 w5 "
    items = [(i, common + text(draw.choice([1, 10, 30]))) for i in range(25)]
    items += [(3, items[3][1]), (3, "other w9"), (None, "w4 w5"), (90, None), (91, ""), (92, "unknown"), (93, "w4")]
    return documents, items


def test_search_equals_brute_force(spark, corpus):
    documents, items = corpus
    assert searched(spark, documents, items) == brute_search(documents, items)


def test_search_in_blocks_of_items(spark, corpus):
    documents, items = corpus
    assert searched(spark, documents, items, block=40, top=3) == brute_search(documents, items, 3)


@pytest.mark.parametrize("empty", ["documents", "items"])
def test_search_of_empty_tables(spark, corpus, empty):
    documents, items = corpus
    assert not searched(spark, [] if empty == "documents" else documents, [] if empty == "items" else items)


def test_shared_sums_equal_plain_ones():
    draw = np.random.default_rng(2)
    items = [np.unique(draw.integers(0, 50, draw.integers(1, 30))) for _ in range(40)]
    items += [np.arange(50), np.arange(25), np.array([7])]
    graph = ranked_search.share(items)
    values = draw.integers(0, 1000, (50, 6))
    sums = np.zeros((graph.nodes, 6), np.int64)
    np.add.at(sums, graph.set_of[np.arange(50)], values)
    expected = np.array([values[item].sum(axis=0) for item in items])
    assert (graph.scores(sums) == expected).all()
    assert len(graph.left) > 0
    # Fewer sums than terms: what is shared is added once.
    assert len(graph.left) + len(graph.tops) < sum(map(len, items))


# Tokenization automaton


@pytest.fixture(scope="module")
def coder():
    return merge_automaton.Coder(WORDS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.no_padding()
    t.no_truncation()
    return t


ODD = [
    "", " ", "a", "</w>", "a</w>b", "<|endoftext|>x<|startoftext|> y<|endoftext|", "x\x00\x1c\x85y z​",
    "é́ ſſ ß İI ΑΣ Σ. 日本語 🙂👍🏽 ½ Ⅷ ２", "a" * 3000, "ab" * 5000, "don't 'S ''ll", "aaaa aaa aa a", "´̸≠ ≮", "x " * 9000,
]


def test_automaton_encodes_as_the_library(spark, folder, coder, library):
    draw = random.Random(8)
    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ODD + ["".join(draw.choices("abcdeinorst'.<>/w1 \n", k=draw.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(draw.randint(1, 0xD7FF)) for _ in range(9)) for _ in range(300)]
    texts += ["".join(chr(draw.randint(1, 0xFF)) for _ in range(6)) for _ in range(5000)]
    texts += [f"a{chr(i)}b{chr(i)}" for i in range(1, 0x300)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def toy(rules, letters="ab"):
    names = list(letters) + [a + b for a, b in rules]
    return merge_automaton.Automaton({t: i for i, t in enumerate(names)}, rules), names


def merged(word, rules):
    parts = list(word)
    for a, b in rules:
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize(
    "rules",
    [
        [("a", "a"), ("aa", "aa"), ("a", "b")],
        [("a", "b"), ("b", "a"), ("ab", "ab"), ("ba", "b"), ("abab", "a")],
        [("b", "b"), ("a", "bb"), ("bb", "a"), ("a", "a"), ("abb", "aa")],
        [("a", "b"), ("a", "ab"), ("aab", "b"), ("b", "aab"), ("ab", "a")],
    ],
)
def test_automaton_has_exactly_the_right_paths(rules):
    automaton, names = toy(rules)
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            right = merged(word, rules)
            assert [names[t] for t in automaton.encode(word)] == right
            # Of all ways to spell the word only one is a path.
            ways = [[]]
            for _ in range(n):
                ways = [w + [t] for w in ways for t in names if word.startswith("".join(w) + t)] + [
                    w for w in ways if "".join(w) == word
                ]
            ways = {tuple(w) for w in ways if "".join(w) == word}
            taken = [w for w in ways if automaton.accepts([names.index(t) for t in w])]
            assert taken == [tuple(right)]


def test_automaton_refuses_what_it_cannot_hold():
    with pytest.raises(ValueError):
        toy([("a", "b"), ("ab", "a"), ("b", "a"), ("a", "ba")])  # aba is made twice
    with pytest.raises(ValueError):
        merge_automaton.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])
    with pytest.raises(ValueError):
        toy([("a", "b")])[0].encode("c")


def test_long_word_and_bounded_tables(library, monkeypatch):
    monkeypatch.setattr(merge_automaton, "ARCS", 50)
    monkeypatch.setattr(merge_automaton, "KNOWN", 3)
    code = merge_automaton.Coder(WORDS)
    text = "".join(random.Random(1).choices("etaoin", k=200_000)) + " one two three four five one two"
    assert code.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert max(len(code.chunks), len(code.words), len(code.latin)) <= 3 and len(code.automaton.arcs) <= 50


def test_automaton_rows(spark, coder):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)] + [(None, "one two", 2, "y"), (7, None, 3, "z"), (7, None, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    encoded = merge_automaton.encode_texts(docs, WORDS)
    expected = Counter((i, tuple(coder.encode(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == expected
    decoded = merge_automaton.decode_ids(encoded, WORDS).collect()
    assert Counter(map(tuple, decoded)) == Counter((i, coder.decode(list(ids)).decode()) for i, ids in expected.elements())

    def sha(data):
        return hashlib.sha256(data).hexdigest()

    wanted = Counter(
        (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(coder.decode(list(ids))))
        for i, ids in expected.elements()
    )
    assert Counter(map(tuple, merge_automaton.round_trip(docs, WORDS).collect())) == wanted
    assert merge_automaton.round_trip(docs.limit(0), WORDS).collect() == []


def test_states_are_those_of_the_merges(coder):
    with open(WORDS) as file:
        merges = json.load(file)["model"]["merges"]
    assert len(coder.automaton.owner) == len(merges) + 1 - sum(coder.automaton.dead)


# Prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(first, [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own_bytes = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own_bytes + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], digest))
    return Counter(out)


def trie(spark, rows, block, parts):
    turns = spark.createDataFrame(
        [(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seq int, origin string"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return Counter(map(tuple, prefix_trie.conversation_trie(turns, block).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block, parts", [(1, 3), (9, 1), (60, 3), (prefix_trie.BLOCK, 1)])
def test_trie_equals_brute_force(spark, block, parts):
    draw = random.Random(block)
    rows = []
    for c in range(100):
        same = draw.random() < 0.4
        for t in range(draw.choice([1, 1, 2, 3, 9, 12])):
            text = "same" if same else draw.choice(["a", "b", None, "", "é"])
            sign = draw.choice([1, 1, -1]) if c < 50 else 1
            rows.append((c * sign, draw.choice([t, t, None]), draw.choice(["u", None]), text))
    rows += [(None, 1, "u", "x"), (7000, 1, "u", "z"), (7000, 1, "u", "z"), (7001, None, None, None)]
    rows += [(10_000 + i, j, "u", f"hot{j}") for i in range(150) for j in range(6)]  # more than a third
    assert trie(spark, rows, block, parts) == brute_trie(rows)


def test_trie_of_turnless_and_long_conversations(spark):
    # 3 takes none of the absent 0 and has no turns after its first h.
    assert trie(spark, [(3, 1, "u", "x")], 4, 1) == brute_trie([(3, 1, "u", "x")])
    rows = [(c, t, "u", "long" if t < 4990 else f"{c} {t}") for c in (10, 15) for t in range(5000)]
    assert trie(spark, rows, 1000, 2) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert not trie(spark, [], 10, 2)


def test_least_values_and_extents():
    draw = np.random.default_rng(4)
    values = draw.integers(0, 6, 70)
    values[0] = -1
    table = prefix_trie.Minima(values)
    a = np.arange(70)
    for b in range(70):
        assert (table.between(a[: b + 1], np.full(b + 1, b)) == [values[i : b + 1].min() for i in a[: b + 1]]).all()
    for least in range(7):
        right = [next((j for j in range(i + 1, 70) if values[j] < least), 70) - 1 for i in a]
        left = [next((j for j in range(i, -1, -1) if values[j] < least), 0) for i in a]
        assert (table.right(a, np.full(70, least)) == right).all()
        assert (table.left(a, np.full(70, least)) == left).all()

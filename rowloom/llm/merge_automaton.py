"""BPE by a tokenization automaton, forth and back.

The automaton reads tokens. It starts with one state that every base symbol
leads back to, so that it takes all strings. Each merge (u, v) -> w, in order,
adds its gadget: if v can follow u, then u leads to a copy of its target that
lacks v, and w leads from wherever u does to where v led. In the end exactly
the right tokenizations are paths, one for each word.

A copy isn't written out: it keeps its parent, the arc it lacks and the merge
that made it, and an arc is looked up through the parents. States made one
after the other by merges with the same left token form a run, so a lookup
takes a step for each run. Arcs that were asked for are kept in a table.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_pieces

START = 0
INNER, FINAL = 0, 1  # keys of the tokens in the tree, beside its letters
ARCS = 2_000_000  # arcs in the table of a worker, at most
KNOWN = 500_000  # words, and strings between blanks, whose ids a worker remembers, at most
KNOWN_CHARS = 64  # longer ones are encoded each time
BLANKS = re.compile(r"[^ \t\n\r\x0b\x0c]+")

# The rules of the public file, and the same for visible characters below U+0100.
USUAL_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
USUAL_SPLITS = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
LATIN = re.compile("[!-~\xa1-\xff]+")
LATIN_LETTERS, LATIN_NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)
# The same for texts of such characters and ASCII blanks.
LATIN_TEXT = re.compile("[ \t-\r!-~\xa1-\xff]*")
LATIN_TEXT_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^ \t-\r{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)


class Automaton:
    """The deterministic automaton of a list of merges over a vocabulary.

    ``end`` is the mark that the last symbol of a word carries. Merges must be
    in order and each must make a token of its own from tokens made before it;
    anything else raises ValueError.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        made = [vocabulary[a + b] for a, b in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make the same token")
        self.size = max(vocabulary.values(), default=-1) + 1
        self.left = [-1] * self.size  # the first part of a merged token
        self.born = [-1] * self.size  # the merge that makes it; -1: a base symbol
        self.dead = [False] * self.size  # its merge never applies
        self.target = [START] * self.size
        self.owner, self.run, self.birth = [-1], [START], [-1]
        self.cut: dict[int, int] = {}  # (left token, missing arc) -> merge
        self.arcs: dict[int, bool] = {}
        known = set(vocabulary.values()) - set(made)
        for k, (a, b) in enumerate(merges):
            u, v = vocabulary[a], vocabulary[b]
            if u not in known or v not in known:
                raise ValueError(f"merge {k} uses a token that is made later")
            known.add(made[k])
            self.merge(k, u, v, made[k])
        self.arcs.clear()
        self.spell(vocabulary, merges, end)

    def merge(self, k: int, u: int, v: int, w: int) -> None:
        """Add the gadget of merge k."""
        self.left[w], self.born[w] = u, k
        before = self.target[u]
        if not self.leads(before, v):
            self.dead[w] = True
            return
        self.target[w] = self.target[v]
        self.cut[u * self.size + v] = k
        # A run begins where its left token led when that token was made.
        self.run.append(self.run[before] if self.owner[before] == u else before)
        self.owner.append(u)
        self.birth.append(k)
        self.target[u] = len(self.owner) - 1

    def leads(self, state: int, token: int) -> bool:
        """Whether an arc with this token leaves the state."""
        until = self.birth[-1]
        while not self.dead[token]:
            at = state
            while at != START:
                k = self.cut.get(self.owner[at] * self.size + token)
                if k is not None and k <= until and k <= self.birth[at]:
                    return False
                at = self.run[at]
            if self.born[token] < 0:
                return True
            # Merged tokens leave from wherever their first part did at that time.
            until = min(until, self.born[token])
            token = self.left[token]
        return False

    def arc(self, state: int, token: int) -> bool:
        """`leads`, by way of the table."""
        key = state * self.size + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self.leads(state, token)
        return found

    def spell(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        """The tokens by their letters, as a tree; those that end a word apart."""
        final = {
            t for t in vocabulary if end and t.endswith(end) and self.born[vocabulary[t]] < 0 and len(t) == len(end) + 1
        }
        for a, b in merges:
            if b in final:
                final.add(a + b)
        self.tree: dict = {}
        for name, token in vocabulary.items():
            letters = name.removesuffix(end) if name in final else name
            node = self.tree
            for letter in letters:
                node = node.setdefault(letter, {})
            if name in final or not end:
                node[FINAL] = token
            if name not in final:
                node[INNER] = token

    def accepts(self, tokens: list[int]) -> bool:
        """Whether the tokens are a path, which means: the right tokenization of a word's start."""
        state = START
        for token in tokens:
            if not self.arc(state, token):
                return False
            state = self.target[token]
        return True

    def starting(self, word: str, at: int) -> list[tuple[int, int]]:
        """The tokens that the word goes on with, and where each stops; the longest last."""
        found, last, node = [], len(word) - 1, self.tree
        for i in range(at, last + 1):
            node = node.get(word[i])
            if node is None:
                return found
            token = node.get(INNER if i < last else FINAL)
            if token is not None:
                found.append((token, i + 1))
        return found

    def encode(self, word: str) -> list[int]:
        """The tokens of the one path that spells the word, in linear time.

        Every start of a word has one state at most. So a place that was
        reached and left again leads nowhere, and no place is tried twice.
        """
        n = len(word)
        ids: list[int] = []
        tried = bytearray(n + 1)
        at, state, ways = 0, START, []
        while at < n:
            ways.append(self.starting(word, at))
            while True:
                while ways[-1]:
                    token, stop = ways[-1].pop()
                    if not tried[stop] and self.arc(state, token):
                        break
                else:
                    ways.pop()
                    if not ids:
                        raise ValueError("the word has symbols that the vocabulary lacks")
                    ids.pop()
                    state = self.target[ids[-1]] if ids else START
                    continue
                break
            ids.append(token)
            tried[stop] = 1
            at, state = stop, self.target[token]
        return ids


class Known(dict):
    """What a function gives for a string, found when first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> list[int]:
        ids = self.find(text)
        if len(text) <= KNOWN_CHARS:
            if len(self) >= KNOWN:
                self.clear()
            self[text] = ids
        return ids


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def has_usual_rules(plan: dict) -> bool:
    """Whether a tokenizer file normalises and splits by the rules above."""
    parts = plan.get("normalizer") or {}, plan.get("pre_tokenizer") or {}
    return [parts[0].get("normalizers"), parts[1].get("pretokenizers")] == [USUAL_NORMALIZERS, USUAL_SPLITS]


class Coder:
    """Encodes and decodes as the tokenizer file says; its library only splits texts into words.

    The file must normalise strings, drop blanks and split into words that no
    blank is part of; words at two sides of an ASCII blank don't depend on each
    other. Strings of special tokens are looked for in the text as it is. If
    the file has the usual rules, strings of Latin letters are split here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        model = plan["model"]
        if model["type"] != "BPE" or plan["decoder"] or plan["post_processor"]:
            raise ValueError("only byte pairs without a decoder or post-processor")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.usual = has_usual_rules(plan)
        self.letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in plan["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        names = {**model["vocab"], **self.special}
        self.labels = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.labels[i] = name.encode()
        self.decimals = [b"%d" % i for i in range(len(self.labels))]
        self.words = Known(self.automaton.encode)
        self.latin = Known(self.encode_latin)
        self.chunks = Known(self.encode_chunk)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a string without ASCII blanks, in letters that stand for bytes."""
        if self.usual and LATIN.fullmatch(chunk):
            words = LATIN_WORDS.findall(chunk.lower())
            if chunk.isascii():
                return words
            return [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [w for w, _ in self.split(self.normalize(chunk))]

    def encode_chunk(self, chunk: str) -> list[int]:
        words = self.words_of(chunk)
        if len(words) == 1:
            return self.words[words[0]]
        return [i for w in words for i in self.words[w]]

    def encode_latin(self, word: str) -> list[int]:
        """The ids of a word of visible characters below U+0100, in lower case."""
        return self.automaton.encode(word.encode().decode("latin-1").translate(self.letters))

    def encode(self, text: str) -> list[int]:
        if not (self.marks and self.marks.search(text)):
            if self.usual and LATIN_TEXT.fullmatch(text):
                words = LATIN_TEXT_WORDS.findall(text.lower())
                return list(chain.from_iterable(map(self.latin.__getitem__, words)))
            return list(chain.from_iterable(map(self.chunks.__getitem__, BLANKS.findall(text))))
        ids: list[int] = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                ids.append(self.special[part])
            else:
                ids += chain.from_iterable(map(self.chunks.__getitem__, BLANKS.findall(part)))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, with a blank between two (the file has no decoder)."""
        return b" ".join([self.labels[i] for i in ids])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each worker, so that its tasks share the automaton."""
    return Coder(path)


def encode_texts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of every text (null or empty: none).

    Every row gives a row; repeated rows, null ids and texts of any length are
    encoded like all others, a word of a million letters in linear time. Other
    columns are not read. An empty table gives no rows.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(path)
        ids = [code.encode(t or "") for t in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
        )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_pieces(docs, work, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded string: the labels of the ids of each row (null: empty)."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            texts = [code.decode(ids or []).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Encodes each text, decodes its ids again, and keeps digests of the decimal
    ids, joined by blanks, and of the decoded text. Edge cases as in
    `encode_texts`; the digest of an empty text is that of no bytes.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(path)
        n, of_ids, of_text = [], [], []
        for text in piece.column(1).to_pylist():
            ids = code.encode(text or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(b" ".join([code.decimals[i] for i in ids])).hexdigest())
            of_text.append(hashlib.sha256(code.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_pieces(docs, work, DIGEST)

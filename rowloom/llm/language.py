"""Languages of texts by segmentation-marginalised unigram models.

A language gives every piece of a fixed public vocabulary a probability. The
probability of a word is the sum over all its segmentations into pieces of the
product of their probabilities, computed by a forward pass; that of a text is
the product over its words. Piece probabilities are learned by expectation
maximisation: forward and backward passes give the expected counts of pieces in
the words of labelled documents.

Passes run over all words of one length at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import pieces, stored

SAMPLE = 3_000  # documents of each language that are learned from, about
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7  # probability of a character that the vocabulary lacks
LONGEST = 40  # characters of a word that are read along with others; learning reads longer ones in parts
CHUNK, RESCALE = 1 << 14, 16  # places of a longer word that are looked up, or passed between scalings
BATCH_BYTES = 8 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLANKS = r"[\p{IsWhite_Space}\x1c-\x1f]+"  # what Arrow takes as white space, too
START = "▁"  # stands before a word, as in the vocabulary


class Vocabulary:
    """The pieces of a SentencePiece model, to be looked up by hash."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        texts = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.longest = max(map(len, texts))
        hashes = np.array([hash_text(t) for t in texts], np.uint64)
        self.keys, first = np.unique(hashes, return_index=True)
        self.single = np.array([len(texts[i]) == 1 for i in first])
        self.size = len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, or `size` for what is none."""
        at = np.searchsorted(self.keys, hashes)
        at[at == self.size] = 0
        return np.where(self.keys[at] == hashes, at, self.size)


def hash_text(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(BASE) + ord(c) + 1) % (1 << 64)
    return value


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_length(words: pa.Array):
    """Numbers and code points of all words of each length; longer ones come in parts."""
    marked = pc.binary_join_element_wise(START, words, "")
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32)
    begins = np.cumsum(lengths) - lengths
    parts = np.maximum(1, -(-lengths // LONGEST))
    which = np.repeat(np.arange(len(words)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = begins[which] + nth * LONGEST
    size = np.minimum(lengths[which] - nth * LONGEST, LONGEST)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        yield which[own], points[begin[own][:, None] + np.arange(n)[None, :]]


def segments(points: np.ndarray, vocab: Vocabulary):
    """(start, length, pieces) of all places in words of one length where any piece stands."""
    count, n = points.shape
    sums = np.zeros((count, n + 1), np.uint64)
    for j in range(n):
        sums[:, j + 1] = sums[:, j] * BASE + points[:, j].astype(np.uint64) + np.uint64(1)
    for length in range(1, min(n, vocab.longest) + 1):
        power = np.uint64(pow(int(BASE), length, 1 << 64))
        for start in range(n - length + 1):
            found = vocab.find(sums[:, start + length] - sums[:, start] * power)
            if length == 1 or (found < vocab.size).any():
                yield start, length, found


def forward(points, vocab, table, own=None):
    """Forward sums of words of one length for all languages, or each for its own one.

    `table` has a row for each piece, a last one for no piece, and a column for
    each language. Returns the sums after every character, and the segments.
    """
    found = sorted(segments(points, vocab), key=lambda s: s[0] + s[1])
    n = points.shape[1]
    wide = (len(points), table.shape[1]) if own is None else (len(points),)
    alpha = np.zeros((n + 1, *wide))
    alpha[0] = 1.0
    values = []
    for start, length, piece in found:
        p = table[piece] if own is None else table[piece, own]
        if length == 1:
            none = piece == vocab.size
            p[none] = UNKNOWN
        values.append(p)
        alpha[start + length] += alpha[start] * p
    return alpha, found, values


def expected_counts(words: pa.Array, times, own, vocab, table) -> np.ndarray:
    """Expected counts of all pieces in words, by language; times: how often each word is there."""
    out = np.zeros(vocab.size * table.shape[1])
    for which, points in by_length(words):
        lang, weight = own[which], times[which]
        alpha, found, values = forward(points, vocab, table, lang)
        n = points.shape[1]
        beta = np.zeros_like(alpha)
        beta[n] = 1.0
        for (start, length, _), p in zip(reversed(found), reversed(values)):
            beta[start] += p * beta[start + length]
        scale = weight / alpha[n]
        for (start, length, piece), p in zip(found, values):
            real = piece < vocab.size
            share = alpha[start] * p * beta[start + length] * scale
            at = piece[real] * table.shape[1] + lang[real]
            out += np.bincount(at, weights=share[real], minlength=len(out))
    return out.reshape(vocab.size, -1)


def long_score(points: np.ndarray, vocab, table) -> np.ndarray:
    """The log probability of one word of any length in every language, over all segmentations.

    The sums of the next places, as many as the longest piece has letters, go
    round in a ring and are scaled again before they get too small.
    """
    n, longest = len(points), vocab.longest
    table = np.vstack([table[: vocab.size], np.zeros(table.shape[1])])
    ring = np.zeros((longest + 1, table.shape[1]))
    ring[0] = 1.0
    lost = np.zeros(table.shape[1])
    for begin in range(0, n, CHUNK):
        starts = min(CHUNK, n - begin)
        letters = points[begin : begin + starts + longest].astype(np.uint64) + np.uint64(1)
        value = np.zeros(starts, np.uint64)
        pieces_at = np.full((longest, starts), vocab.size, np.int64)
        for length in range(1, longest + 1):
            fit = max(0, min(starts, len(letters) - length + 1))
            value = value[:fit] * BASE + letters[length - 1 : length - 1 + fit]
            pieces_at[length - 1, :fit] = vocab.find(value)
        known = pieces_at < vocab.size
        reach = np.where(known.any(axis=0), longest - known[::-1].argmax(axis=0), 1).tolist()
        single = known[0].tolist()
        for i in range(starts):
            at = (begin + i) % (longest + 1)
            here, ring[at] = ring[at].copy(), 0.0
            gain = here * table[pieces_at[: reach[i], i]]
            if not single[i]:
                gain[0] = here * UNKNOWN
            ring[(at + 1 + np.arange(reach[i])) % (longest + 1)] += gain
            if i % RESCALE == 0:
                top = ring.max(axis=0)
                ring /= top
                lost += np.log(top)
    return np.log(ring[n % (longest + 1)]) + lost


def word_scores(words: pa.Array, vocab, table) -> np.ndarray:
    """Log probabilities of words in every language, summed over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    long = pc.greater(pc.utf8_length(words), LONGEST - len(START)).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(~long)
    if len(short):
        for which, points in by_length(words.take(pa.array(short))):
            alpha, _, _ = forward(points, vocab, table)
            out[short[which]] = np.log(alpha[-1])
    for i in np.flatnonzero(long).tolist():
        points = np.frombuffer((START + words[i].as_py()).encode("utf-32-le"), np.uint32)
        out[i] = long_score(points, vocab, table)
    return out


def with_fold(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang and the remainder that decides whether a row is held out."""
    return documents.selectExpr(
        "cast(doc_id AS bigint) AS doc_id",
        "cast(text AS string) AS text",
        "cast(lang AS string) AS lang",
        "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) AS fold",
    )


def learn(documents: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """The languages, and the probabilities of all pieces in each.

    From about SAMPLE documents of each language, chosen by a hash of their
    ids, that have text, lang and id and are not held out. Words are counted by
    Spark; tasks add up expected counts, which come to the driver as one row
    for each piece and language.
    """
    known = with_fold(documents).where(
        "fold <> 2 AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL"
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    chance = F.create_map(
        *[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / counts[lang]))]
    )
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30)
    words = stored(
        known.where(drawn)
        .select(
            number[F.col("lang")].alias("own"),
            F.explode(F.split(F.lower("text"), BLANKS)).alias("word"),
        )
        .where("word <> ''")
        .groupBy("own", "word")
        .count(),
        "language-words",
    )
    vocab = vocabulary(path)
    table = np.full((vocab.size + 1, len(langs)), 1 / vocab.size)
    table[-1] = 0.0
    for _ in range(ROUNDS):

        def run(batches, table=table):
            total = None
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                times = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                new = expected_counts(
                    batch.column(1).cast(pa.string()), times, own, vocabulary(path), table
                )
                total = new if total is None else total + new
            if total is not None:
                flat = total.reshape(-1)
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(flat[at])], ["at", "expected"]
                )

        sums = (
            words.mapInArrow(run, "at long, expected double")
            .groupBy("at")
            .agg(F.sum("expected").alias("expected"))
            .toPandas()
        )
        flat = np.full(vocab.size * len(langs), SMOOTHING)
        flat[sums["at"].to_numpy(np.int64)] += sums["expected"].to_numpy(float)
        own = flat.reshape(vocab.size, len(langs))
        table = np.vstack([own / own.sum(axis=0), np.zeros((1, len(langs)))])
    return langs, table


def predict(documents: DataFrame, path: str, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    The score is the probability of the predicted language among those learned,
    each as likely as any other beforehand; the first in order wins a tie. A
    null text, or one without a letter, is `und` with score 0, as is every text
    if no language was learned. A null id is not held out and stays null;
    repeated rows give repeated results; other columns are not read.
    """

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                yield score_rows(piece, vocab, langs, table)

    docs = with_fold(documents).selectExpr("doc_id", "coalesce(fold = 2, false) AS held_out", "text")
    return docs.mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def score_rows(piece: pa.RecordBatch, vocab, langs: list[str], table: np.ndarray) -> pa.RecordBatch:
    text = pc.fill_null(piece.column(2), "").cast(pa.large_string())
    named = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    lists = pc.utf8_split_whitespace(pc.utf8_lower(text))
    coded = lists.values.dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    which = coded.indices.to_numpy(zero_copy_only=False)
    if langs:
        words = word_scores(coded.dictionary.cast(pa.string()), vocab, table)
        logs = np.stack(
            [np.bincount(row, weights=words[which, i], minlength=len(text)) for i in range(len(langs))],
            axis=1,
        )
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.where(named, np.array(langs, object)[best], "und")
        share = np.where(named, share, 0.0)
    else:
        names, share = np.full(len(text), "und", object), np.zeros(len(text))
    return pa.RecordBatch.from_arrays(
        [piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(share)],
        ["doc_id", "held_out", "lang_pred", "score"],
    )


def identify(documents: DataFrame, path: str) -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict for all."""
    langs, table = learn(documents, path)
    return predict(documents, path, langs, table)

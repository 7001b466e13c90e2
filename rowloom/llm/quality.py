"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a text and rejects texts beyond a cutoff. Cutoffs
are learned from labelled documents, apart for every stratum: on one half cutoffs
are proposed for each rule, and on the held-out half an exact binomial
(Clopper-Pearson) upper bound of the share of good documents that it rejects
must stay below the rule's part of ``RISK``. The error level is divided by the
number of all tests that could be made (Bonferroni), so that all cutoffs hold
together. A rule that never passes rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import (
    SPACES,
    TOKENS,
    find_words,
    hash_spans,
    map_pieces,
    pieces,
    stored,
    text_bytes,
    windows,
)

RISK = 0.05  # share of good documents that all rules together may reject in a stratum
ERROR = 0.05  # chance that any of the bounds fails
GRID = 32  # cutoffs that are looked at for each rule, at most
BIN = 2_000  # bad documents in a bin of values that are put in order together, about
BINS = 256  # such bins of a stratum, at most; they grow beyond that
LADDER = 3  # of which so many are tested
STRATA = ("short", "middle", "long")  # by number of words: under 100, under 1000, more

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = {
    "symbols": "n_symbols per word",
    "marks": "share of punctuation in characters",
    "bars": "share of words that are one punctuation mark",
    "repeats": "share of words in repeated windows",
    "duplicate_lines": "share of lines that repeat an earlier one",
    "few_kinds": "one less the share of different words",
    "word_length": "characters per word",
}

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARK = np.ones(256, bool)  # ASCII but letters, digits and white space
MARK[SPACES] = MARK[0x30:0x3A] = MARK[0x41:0x5B] = MARK[0x61:0x7B] = MARK[0x80:] = False
FIRST_BYTE = np.ones(256, bool)  # of a character in UTF-8
FIRST_BYTE[0x80:0xC0] = False


def count_in(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row of bytes."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in rows: which occur twice or more in their row, which come after the first."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    later = np.concatenate([[False], same])
    twice = later | np.concatenate([same, [False]])
    out = np.zeros((2, len(keys)), bool)
    out[0, order], out[1, order] = twice, later
    return out[0], out[1]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules and the statistics of the others for every text."""
    raw, at = text_bytes(column)
    n_rows = len(at) - 1
    starts, ends, first = find_words(raw, at, TOKENS)
    words = hash_spans(raw, starts, ends, lower=False)
    n = np.diff(first)
    row = np.repeat(np.arange(n_rows), n)
    letters = FIRST_BYTE[raw]
    spaces = SPACES[raw]
    out = {
        "n_words": n,
        "word_chars": count_in(letters & ~spaces, at),
        "n_symbols": count_in(SYMBOLS[raw], at),
    }
    # windows of three words, and the words in those that are found again
    every = windows(words, 3)
    inside = row[: len(every)] == row[2 : 2 + len(every)]
    where = np.flatnonzero(inside)
    twice, _ = repeated(every[where], row[where])
    cover = np.zeros(len(words) + 1, np.int64)
    hits = where[twice]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + 3, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n_rows)
    # lines with a word, by the hash of all their bytes
    breaks = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([at, breaks, breaks + 1]))
    begin, end = edges[:-1], edges[1:]
    full = np.diff(np.searchsorted(starts, edges)) > 0
    begin, end = begin[full], end[full]
    line_row = np.searchsorted(at, begin, side="right") - 1
    _, later = repeated(hash_spans(raw, begin, end, lower=False), line_row)
    n_lines = np.bincount(line_row, minlength=n_rows)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n_rows)
    # statistics of the rules
    _, again = repeated(words, row)
    chars = np.maximum(1, out["word_chars"])
    one = (ends - starts == 1) & MARK[raw[starts]] if len(starts) else np.zeros(0, bool)
    words_or_1 = np.maximum(1, n)
    out |= {
        "symbols": out["n_symbols"] / words_or_1,
        "marks": count_in(MARK[raw], at) / chars,
        "bars": np.bincount(row[one], minlength=n_rows) / words_or_1,
        "repeats": out["n_repeat_words"] / words_or_1,
        "duplicate_lines": out["n_dup_lines"] / np.maximum(1, n_lines),
        "few_kinds": np.bincount(row[again], minlength=n_rows) / words_or_1,
        "word_length": out["word_chars"] / words_or_1,
    }
    out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
    out["stratum"] = (n >= 100).astype(np.int64) + (n >= 1000)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of at most k hits in n trials, exactly."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, error: float) -> float:
    """The Clopper-Pearson upper bound of a share of which k of n were seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if binomial_tail(k, n, middle) > error:
            low = middle
        else:
            high = middle
    return high


@dataclass(frozen=True)
class Cutoffs:
    """The cutoff of every stratum and rule (infinite: rejects nothing), and its bound."""

    values: dict[tuple[int, str], float]
    bounds: dict[tuple[int, str], float]

    def verdict(self, measured: dict[str, np.ndarray]) -> np.ndarray:
        kept = ~measured["base_failed"]
        for (stratum, rule), cutoff in self.values.items():
            kept &= ~((measured["stratum"] == stratum) & (measured[rule] > cutoff))
        return kept


def grid_ranks(n: int) -> list[int]:
    """The places, from 0, of the values of n sorted ones whose surroundings are looked at."""
    return sorted({int(i) for i in np.floor((n - 1) * np.linspace(0, 1, GRID))})


def halfway(value: float, below: float | None) -> float:
    """The cutoff between a bad value and the largest good one below it, if any."""
    return (value + below) / 2 if below is not None else value / 2


def best_first(seen: list[tuple[float, float, float]], allowed: float) -> list[float]:
    """Of (cutoff, share of good documents lost, share of bad ones gained) the best cutoffs."""
    found = [(-gain, -cutoff) for cutoff, loss, gain in seen if loss <= allowed / 2 and gain > 2 * loss]
    return [-c for _, c in sorted(found)[:LADDER]]


def proposals(good: np.ndarray, bad: np.ndarray, allowed: float) -> list[float]:
    """Cutoffs for one rule, best first: halfway from good values to the bad ones beyond."""
    seen = []
    for c in np.unique(np.sort(bad)[grid_ranks(len(bad))]):
        below = good[good < c]
        cutoff = halfway(float(c), float(below.max()) if len(below) else None)
        seen.append((cutoff, (good > cutoff).sum() / len(good), (bad > cutoff).sum() / len(bad)))
    return best_first(seen, allowed)


Cuts = dict[int, list[float]]  # cutoffs of one rule, by stratum
Propose = Callable[[str, dict[tuple[int, str], float], float], Cuts]
Held = Callable[[str, Cuts], dict[int, tuple[int, list[int]]]]


def choose_cutoffs(propose: Propose, held: Held, risk: float = RISK, error: float = ERROR) -> Cutoffs:
    """The first of the proposed cutoffs of each stratum and rule whose bound holds.

    Rules take turns. ``propose(rule, values so far, allowed share)`` gives, for
    each stratum, cutoffs for the bad documents that the rules before have left.
    ``held(rule, cutoffs by stratum)`` gives, for each stratum, the number of
    held-out good documents and how many each cutoff rejects.
    """
    allowed = risk / len(RULES)
    level = error / (len(STRATA) * len(RULES) * LADDER)
    values, bounds = {}, {}
    for rule in RULES:
        proposed = {s: cutoffs for s, cutoffs in propose(rule, values, allowed).items() if cutoffs}
        values |= {(s, rule): math.inf for s in range(len(STRATA))}
        bounds |= {(s, rule): 0.0 for s in range(len(STRATA))}
        counted = held(rule, proposed) if proposed else {}
        for s, (n, rejected) in counted.items():
            for cutoff, k in zip(proposed[s], rejected):
                bound = upper_bound(k, n, level)
                if bound <= allowed:
                    values[s, rule], bounds[s, rule] = cutoff, bound
                    break
    return Cutoffs(values, bounds)


def fit_cutoffs(rows: np.ndarray, risk: float = RISK, error: float = ERROR) -> Cutoffs:
    """`choose_cutoffs` for rows (fold, stratum, quality, then a column for each rule) in memory.

    Those of fold 0 propose, those of fold 1 are held out.
    """
    fit, test = rows[rows[:, 0] == 0], rows[(rows[:, 0] == 1) & (rows[:, 2] == 1)]
    column = {rule: j for j, rule in enumerate(RULES, 3)}

    def propose(rule: str, values: dict[tuple[int, str], float], allowed: float) -> Cuts:
        out = {}
        for s in range(len(STRATA)):
            good, left = (fit[(fit[:, 1] == s) & (fit[:, 2] == quality)] for quality in (1, 0))
            for (stratum, earlier), cutoff in values.items():
                if stratum == s:
                    left = left[left[:, column[earlier]] <= cutoff]
            if len(good) and len(left):
                out[s] = proposals(good[:, column[rule]], left[:, column[rule]], allowed)
        return out

    def held(rule: str, cutoffs: Cuts) -> dict[int, tuple[int, list[int]]]:
        own = {s: test[test[:, 1] == s][:, column[rule]] for s in cutoffs}
        return {s: (len(own[s]), [int((own[s] > c).sum()) for c in cutoffs[s]]) for s in cutoffs}

    return choose_cutoffs(propose, held, risk, error)


MEASURED = ", ".join(f"{n} long" for n in ["doc_id", "fold", "stratum", *BASE]) + (
    ", base_failed boolean, " + ", ".join(f"{n} double" for n in RULES)
)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, fold, stratum, the counts, base_failed and the statistics of every row.

    Folds go by a hash of the text, so that copies of a text are in one fold.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(piece.column(1))
        columns = [piece.column(0), piece.column(2), pa.array(m["stratum"].astype(np.int64))]
        columns += [pa.array(m[n].astype(np.int64)) for n in BASE]
        columns += [pa.array(m["base_failed"])]
        columns += [pa.array(m[rule].astype(np.float64)) for rule in RULES]
        names = ["doc_id", "fold", "stratum", *BASE, "base_failed", *RULES]
        return pa.RecordBatch.from_arrays(columns, names)

    text = F.col("text").cast("string")
    fold = F.pmod(F.xxhash64(text), F.lit(2)).alias("fold")
    return map_pieces(documents.select(F.col("doc_id").cast("long"), text.alias("text"), fold), work, MEASURED)


def learn(documents: DataFrame, labels: DataFrame) -> Cutoffs:
    """The cutoffs for the given labels; without labels no rule rejects anything."""
    return learn_from(measured(documents), labels)


def counts_beyond(rows: DataFrame, rule: str, cutoffs: Cuts) -> dict[int, tuple[int, list[int]]]:
    """For each stratum the number of rows, and of those beyond each cutoff. One aggregation."""
    asked = [f"count_if(stratum = {s}) AS n{s}" for s in cutoffs]
    asked += [
        f"count_if(stratum = {s} AND `{rule}` > {c!r}D) AS k{s}_{i}" for s, cs in cutoffs.items() for i, c in enumerate(cs)
    ]
    found = rows.selectExpr(*asked).head()
    return {s: (found[f"n{s}"], [found[f"k{s}_{i}"] for i in range(len(cs))]) for s, cs in cutoffs.items()}


def bin_edges(rows: DataFrame) -> dict[tuple[int, str], list[float]]:
    """Values that deal the rows of a stratum into bins of `BIN` rows or a `BINS`th, by stratum and rule.

    They come from quantile sketches and only say which rows are put in order
    together; ranks are counted exactly.
    """
    sizes = {r["stratum"]: r["count"] for r in rows.groupBy("stratum").count().collect()}
    bins = min(BINS, max(sizes.values(), default=0) // BIN + 1)
    if bins == 1:
        return {(s, rule): [] for s in sizes for rule in RULES}
    shares = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    sketches = [f"percentile_approx(`{rule}`, array({shares}), {10 * bins}) AS `{rule}`" for rule in RULES]
    found = rows.groupBy("stratum").agg(*[F.expr(e) for e in sketches]).collect()
    return {(r["stratum"], rule): sorted(set(r[rule])) for r in found for rule in RULES}


def grid_values(rows: DataFrame, rule: str, edges: dict[int, list[float]]) -> Cuts:
    """The different values at `grid_ranks` of the sorted values of every stratum, exactly.

    Equal values are counted first; bins lie one after the other, so that the
    rank of a value is its rank in its bin and the sizes of the bins before.
    """
    arrays = " ".join(
        f"WHEN {s} THEN array_size(filter(array({', '.join(f'{e!r}D' for e in es)}), e -> e < value))"
        for s, es in edges.items() if es
    )
    place = f"CASE stratum {arrays} ELSE 0 END" if arrays else "0"
    values = rows.groupBy("stratum", F.col(rule).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = stored(values.withColumn("bin", F.expr(place)), "quality-values")
    sizes: dict[int, dict[int, int]] = {}
    for r in values.groupBy("stratum", "bin").agg(F.sum("n").alias("n")).collect():
        sizes.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    wanted = []
    for s, bins in sizes.items():
        ranks, start = grid_ranks(sum(bins.values())), 0
        for b in sorted(bins):
            inside = [r - start for r in ranks if start <= r < start + bins[b]]
            wanted += [(s, b, r) for r in inside]
            start += bins[b]
    if not wanted:
        return {}
    order = Window.partitionBy("stratum", "bin").orderBy("value")
    upto = values.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    asked = rows.sparkSession.createDataFrame(wanted, "stratum long, bin int, rank long")
    at = upto.join(F.broadcast(asked), ["stratum", "bin"]).where("rank >= upto - n AND rank < upto")
    out: Cuts = {}
    for r in at.select("stratum", "value").distinct().collect():
        out.setdefault(r["stratum"], []).append(r["value"])
    return {s: sorted(found) for s, found in out.items()}


def learn_from(rows: DataFrame, labels: DataFrame) -> Cutoffs:
    """The cutoffs for labelled rows of `measured`.

    Cutoffs are proposed from all labelled documents of one fold, and the
    bounds count all those of the other. Each rule takes a few aggregations,
    whose few numbers reach the driver. An id
    with several labels has the lowest. Documents that fail the base rules are
    left out, as the cutoffs never decide on them.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    open_ = rows.where("doc_id IS NOT NULL AND NOT base_failed").select("doc_id", "fold", "stratum", *RULES)
    rows = stored(open_.join(known, "doc_id"), "quality-labelled")
    good, bad = (rows.where(f"fold = 0 AND quality = {quality}") for quality in (1, 0))
    test = rows.where("fold = 1 AND quality = 1")
    edges = bin_edges(bad)

    def propose(rule: str, values: dict[tuple[int, str], float], allowed: float) -> Cuts:
        left = bad
        for (s, earlier), cutoff in values.items():
            if math.isfinite(cutoff):
                left = left.where(f"NOT (stratum = {s} AND `{earlier}` > {cutoff!r}D)")
        grid = grid_values(left, rule, {s: es for (s, of), es in edges.items() if of == rule})
        if not grid:
            return {}
        asked = [
            f"max(CASE WHEN stratum = {s} AND `{rule}` < {c!r}D THEN `{rule}` END) AS b{s}_{i}"
            for s, cs in grid.items() for i, c in enumerate(cs)
        ]
        below = good.selectExpr(*asked).head()
        cuts = {s: [halfway(c, below[f"b{s}_{i}"]) for i, c in enumerate(cs)] for s, cs in grid.items()}
        lost, gained = counts_beyond(good, rule, cuts), counts_beyond(left, rule, cuts)
        return {
            s: best_first([(c, k / lost[s][0], g / gained[s][0]) for c, k, g in zip(cs, lost[s][1], gained[s][1])], allowed)
            for s, cs in cuts.items()
            if lost[s][0]
        }

    return choose_cutoffs(propose, lambda rule, cutoffs: counts_beyond(test, rule, cutoffs))


def verdicts(rows: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """The columns of `judge`, from rows of `measured`."""
    beyond = [f"stratum = {s} AND `{rule}` > {c!r}D" for (s, rule), c in cutoffs.values.items() if math.isfinite(c)]
    rejected = " OR ".join(f"({e})" for e in ["base_failed", *beyond])
    names = ", ".join(f"'{n}'" for n in STRATA)
    return rows.selectExpr(
        "doc_id", *BASE, "base_failed", f"NOT ({rejected}) AS kept", f"array({names})[CAST(stratum AS INT)] AS stratum"
    )


def learn_and_judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `judge` with the cutoffs of `learn`; every text is measured once, and the numbers written."""
    rows = stored(measured(documents), "quality-measured")
    return verdicts(rows, learn_from(rows, labels))


SCHEMA = ", ".join(f"{n} long" for n in ["doc_id", *BASE]) + (
    ", base_failed boolean, kept boolean, stratum string"
)


def judge(documents: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """doc_id, n_words, the counts of the base rules, base_failed, kept, stratum.

    One row for each row of documents; a null id stays null, repeated rows are
    repeated, a null or empty text has no words and fails. Other columns are
    not read. Texts are used whole.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(piece.column(1))
        columns = [piece.column(0), *(pa.array(m[n].astype(np.int64)) for n in BASE)]
        columns += [pa.array(m["base_failed"]), pa.array(cutoffs.verdict(m))]
        columns.append(pa.array([STRATA[i] for i in m["stratum"]], pa.string()))
        return pa.RecordBatch.from_arrays(
            columns, ["doc_id", *BASE, "base_failed", "kept", "stratum"]
        )

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_pieces(docs, work, SCHEMA)


def keep_good(documents: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """The rows of documents, with all columns, that are kept."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                m = measure(piece.column(at).cast(pa.string()))
                yield piece.filter(pa.array(cutoffs.verdict(m)))

    return documents.mapInArrow(run, documents.schema)

"""Personal data: fixed forms, and identifiers found by bootstrapped contexts.

Spark SQL functions only. Four fixed forms give the base spans. They are also
the seeds of a bootstrap: the words beside a seed are patterns; patterns and
identifier-like words form a graph, whose scores Spark passes back and forth a
few times; what stands beside high-confidence patterns and has the form of
their kind is a span too.

Regular expressions are written so that Java's engine neither recurses nor
rescans on long runs: repeated groups are replaced by marks for separators
inside a run, and searches start at the start of a run only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 5  # distinct seeds that a pattern needs
CONFIDENT = 0.8  # score of a pattern that may find identifiers
SMOOTHING = 1.0
BLOCK = 64

# Characters that no text has: around matches, for a dot, a blank and a hyphen within a run.
# Where a text does have one, it is read as a blank.
CUT, DOT, GAP, DASH = "﷐", "﷑", "﷒", "﷓"
MARKS = f"{CUT}{DOT}{GAP}{DASH}"

# The matches of each form in a prepared text, what must be in a text that has one, and what
# prepares it; § stands for the text. `\G` lets a search go on within a run of which a match
# has taken the start.
FORMS = {
    "email": (
        rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@"
        rf"[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+",
        "contains(§, '@')",
        rf"regexp_replace(§, '(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])', '{DOT}')",
    ),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"§ RLIKE '[0-9]\\.[0-9]'",
        "§",
    ),
    "card": (
        rf"[0-9][0-9{GAP}{DASH}]++",
        "§ RLIKE '[0-9](?:[ -]?[0-9]){15}'",
        f"regexp_replace(regexp_replace(§, '(?<=[0-9]) (?=[0-9])', '{GAP}'),"
        f" '(?<=[0-9])-(?=[0-9])', '{DASH}')",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(§, '+')", "§"),
    # an identifier-like word: one with a digit or an at sign
    "word": (r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "§ RLIKE '[0-9@]'", "§"),
    # groups of digits with blanks between them
    "run": (
        r"(?<![A-Za-z0-9.@+_(-])[(]?[0-9][\x20().0-9-]*[0-9](?![A-Za-z0-9@_])",
        "§ RLIKE '[0-9][).-]? [(]?[0-9]'",
        "§",
    ),
}
DIGITS = "translate(m.m, translate(m.m, '0123456789', ''), '')"
LUHN = (
    f"aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + CASE"
    f" WHEN i % 2 = 1 THEN cast(substr({DIGITS}, -i, 1) AS int)"
    f" WHEN cast(substr({DIGITS}, -i, 1) AS int) > 4"
    f" THEN 2 * cast(substr({DIGITS}, -i, 1) AS int) - 9"
    f" ELSE 2 * cast(substr({DIGITS}, -i, 1) AS int) END) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": "forall(split(m.m, '[.]'), p -> length(ltrim('0', p)) <= 3"
    " AND cast(concat('0', ltrim('0', p)) AS bigint) <= 255)",
    "card": f"CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN {LUHN} ELSE false END",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "word": "length(m.m) BETWEEN 6 AND 64",
    "run": f"contains(m.m, ' ') AND length({DIGITS}) BETWEEN 7 AND 19",
}
# The form that an identifier must have to be taken for a kind.
LIKE = {
    "email": "^[^@]{1,40}@[^@]{2,40}$",
    "ip": "^[0-9]{1,5}[.][0-9]{1,5}[.][0-9]{1,5}[.][0-9]{1,5}$",
    "card": "^[0-9][0-9-]{10,20}[0-9]$",
    "phone": "^[(+]?[0-9][0-9().-]{5,18}[0-9]$",
}
# The same of groups of digits: single blanks, dots and hyphens, a blank also beside a bracket.
LIKE_RUN = {
    "card": "^(?=(?:[^0-9]*[0-9]){12,19}$)[0-9]{2,}(?:[ -][0-9]{2,})+$",
    "phone": "^(?=(?:[^0-9]*[0-9]){7,15}$)[(]?[0-9]+(?:(?:[ .-]|[)][ .-]?| [(])[0-9]+)+$",
}
TRIM = "'\"''.,;:!?|<>[]{}='"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut_expr(kind: str, text: str) -> str:
    """The text in parts, of which every second is a match; one part if nothing matches."""
    pattern, has, prepare = FORMS[kind]
    marked = f"regexp_replace({prepare}, {quoted(pattern)}, '{CUT}$0{CUT}')"
    if prepare != "§":
        marked = f"translate({marked}, '{DOT}{GAP}{DASH}', '. -')"
    cut = f"CASE WHEN {has} THEN split({marked}, '{CUT}', -1) ELSE array('') END"
    return cut.replace("§", text)


def clean_expr(text: str) -> str:
    """The text, blanks for the marks used here."""
    return (
        f"CASE WHEN {text} RLIKE '[{MARKS}]' THEN translate({text}, '{MARKS}', '    ')"
        f" ELSE {text} END"
    )


KEY = "xxhash64(coalesce(cast(text AS string), ''), 'text')"  # of a row's text


def match_expr(kind: str, before: int) -> str:
    """Valid matches of the parts p_kind as structs s, e, m, l, r; positions in code points."""
    p, n, b = f"p_{kind}", f"n_{kind}", f"b_{kind}"
    at = (
        f"{b}[cast((2 * i - 1) div {BLOCK} AS int)] + aggregate(slice("
        f"{n}[cast((2 * i - 1) div {BLOCK} AS int)], 1, cast((2 * i - 1) % {BLOCK} AS int)),"
        " 0L, (a, x) -> a + x)"
    )
    count = f"cast((size({p}) - 1) div 2 AS int)"
    every = (
        f"transform(slice(sequence(0, {count}), 2, {count}), i -> named_struct("
        f"'s', {at}, 'e', {at} + length({p}[2 * i - 1]), 'm', {p}[2 * i - 1],"
        f" 'l', lower(right({p}[2 * i - 2], {before})), 'r', lower(left({p}[2 * i], {before}))))"
    )
    return f"filter({every}, m -> {VALID[kind]})"


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, key, and for every form an array of its valid matches, in one pass."""
    docs = documents.selectExpr(
        "cast(doc_id AS bigint) AS doc_id",
        f"{KEY} AS key",
        f"coalesce({clean_expr('cast(text AS string)')}, '') AS t",
    )
    parts = docs.selectExpr("doc_id", "key", *(f"{cut_expr(k, 't')} AS p_{k}" for k in FORMS))
    # lengths of the parts in blocks, and the length of all blocks before each, so that the
    # work stays in proportion to the matches of a text
    lengths = parts.selectExpr(
        "*", *(f"transform(p_{k}, x -> cast(length(x) AS bigint)) AS l_{k}" for k in FORMS)
    )
    blocks = lengths.selectExpr(
        "doc_id",
        "key",
        *(f"p_{k}" for k in FORMS),
        *(
            f"transform(sequence(0, cast((size(l_{k}) - 1) div {BLOCK} AS int)),"
            f" k -> slice(l_{k}, k * {BLOCK} + 1, {BLOCK})) AS n_{k}"
            for k in FORMS
        ),
    )
    sums = blocks.selectExpr(
        "*",
        *(
            f"aggregate(n_{k}, array(0L), (a, n) -> array_append(a, element_at(a, -1)"
            f" + aggregate(n, 0L, (c, x) -> c + x))) AS b_{k}"
            for k in FORMS
        ),
    )
    return sums.selectExpr("doc_id", "key", *(f"{match_expr(k, 32)} AS {k}" for k in FORMS))


PATTERNS = (
    "filter(array("
    "concat('l:', element_at(split(trim({l}), '\\\\s+'), -1)),"
    "concat('r:', split(trim({r}), '\\\\s+')[0])),"
    " p -> length(p) > 3)"
)


def identifiers(found: DataFrame) -> DataFrame:
    """An array of the identifier-like words and groups of digits of each row that
    overlap no base span. Words within groups are there, too."""
    base = f"concat({', '.join(KINDS)})"
    runs = (
        "transform(run, w -> named_struct('s', w.s, 'm', w.m, 'l', w.l, 'r', w.r))"
    )
    tidy = (
        "transform(word, w -> named_struct("
        f"'s', w.s + length(w.m) - length(ltrim({TRIM}, w.m)),"
        f" 'm', trim(BOTH {TRIM} FROM w.m), 'l', w.l, 'r', w.r))"
    )
    return found.selectExpr(
        "doc_id",
        "key",
        f"filter(concat({tidy}, {runs}), w -> length(w.m) >= 6 AND NOT exists({base},"
        " b -> b.s < w.s + length(w.m) AND w.s < b.e)) AS words",
    )


def occurrences(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (kind, instance, pattern) and other identifiers (row, place, kind, ...)."""
    seeds = found.selectExpr(
        "inline(concat("
        + ", ".join(
            f"transform({k}, m -> named_struct('kind', '{k}', 'instance', lower(m.m),"
            f" 'patterns', {PATTERNS.format(l='m.l', r='m.r')}))"
            for k in KINDS
        )
        + "))"
    ).selectExpr("kind", "instance", "explode(patterns) AS pattern")
    kinds = ", ".join(
        f"CASE WHEN w.m RLIKE {quoted(p)} THEN '{k}' END"
        for like in (LIKE, LIKE_RUN)
        for k, p in like.items()
    )
    others = (
        identifiers(found)
        .selectExpr("doc_id", "key", "explode(words) AS w")
        .selectExpr(
            "doc_id",
            "key",
            "w.s AS start",
            "w.s + length(w.m) AS end",
            "lower(w.m) AS instance",
            f"array_distinct(filter(array({kinds}), k -> k IS NOT NULL)) AS kinds",
            f"{PATTERNS.format(l='w.l', r='w.r')} AS patterns",
        )
    )
    return seeds, others


def bootstrap(found: DataFrame) -> DataFrame:
    """Identifiers beside confident patterns: doc_id, key, kind, start, end.

    Edges of the graph are the distinct (kind, instance, pattern). A pattern
    takes part with ``MIN_SEEDS`` distinct seeds, to which instances of a
    confident value are added from the second round on. A pattern's
    score for a kind is the sum of its instances' scores over the number of all
    its instances, of whatever form, plus ``SMOOTHING``. Seeds score 1, other
    instances the mean score of their patterns. Sums are made map-side; every
    round's scores are written and read again, so that hot patterns are joined
    as plain tables whose skew Spark splits.
    """
    seeds, others = occurrences(found)
    seeds = seeds.distinct()
    others = stored(others, "pii-words")
    linked = others.selectExpr("kinds", "instance", "explode(patterns) AS pattern")
    total = stored(
        seeds.select("instance", "pattern")
        .union(linked.select("instance", "pattern"))
        .distinct()
        .groupBy("pattern")
        .agg(F.count("*").alias("total")),
        "pii-totals",
    )
    sure = stored(
        seeds.groupBy("kind", "pattern").agg(F.count("*").alias("seeds")).where(
            F.col("seeds") >= MIN_SEEDS
        ),
        "pii-seeds",
    )
    edges = stored(
        linked.selectExpr("explode(kinds) AS kind", "instance", "pattern").distinct(), "pii-edges"
    )
    known = seeds.groupBy("kind", "pattern").agg(F.count("*").alias("seeds"))
    scores = stored(
        sure.join(total, "pattern").selectExpr(
            "kind", "pattern", f"seeds / (total + {SMOOTHING}) AS score"
        ),
        "pii-scores",
    )
    for _ in range(ROUNDS - 1):
        instances = stored(
            edges.join(scores, ["kind", "pattern"])
            .groupBy("kind", "instance")
            .agg(F.avg("score").alias("value")),
            "pii-instances",
        )
        gained = (
            edges.join(instances, ["kind", "instance"])
            .groupBy("kind", "pattern")
            .agg(
                F.sum("value").alias("gain"),
                F.count(F.when(F.col("value") >= CONFIDENT, 1)).alias("confident"),
            )
        )
        scores = stored(
            known.join(gained, ["kind", "pattern"], "full")
            .where(f"coalesce(seeds, 0) + coalesce(confident, 0) >= {MIN_SEEDS}")
            .join(total, "pattern")
            .selectExpr(
                "kind",
                "pattern",
                f"(coalesce(seeds, 0) + coalesce(gain, 0D)) / (total + {SMOOTHING}) AS score",
            ),
            "pii-scores",
        )
    return (
        others.selectExpr(
            "doc_id", "key", "start", "end", "explode(kinds) AS kind", "patterns"
        )
        .selectExpr("doc_id", "key", "kind", "start", "end", "explode(patterns) AS pattern")
        .join(scores.where(F.col("score") >= CONFIDENT), ["kind", "pattern"], "left_semi")
        .select("doc_id", "key", "kind", "start", "end")
        .distinct()
    )


def span_texts(kinds: dict[str, str]) -> str:
    """kind:start:end of arrays of spans, by kind and start, joined by commas."""
    return (
        "array_join(concat("
        + ", ".join(
            f"transform({spans}, m -> concat('{k}:', m.s, ':', m.e))" for k, spans in kinds.items()
        )
        + "), ',')"
    )


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Base spans are counted and digested; `spans` has those that the bootstrap
    adds, too, under the kind of their pattern. A null or empty text has none.
    Repeated rows give repeated results, a null id stays null, other columns
    are not read. Positions are code points. The bootstrap looks at distinct
    identifiers, so that copies of a document add nothing to a pattern.
    """
    found = stored(scan(documents), "pii-spans")
    added = (
        bootstrap(found)
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("kind", F.col("start").alias("s"), F.col("end").alias("e"))))
        .toDF("id", "other_key", "added")
    )
    added = stored(added, "pii-added")
    slim = found.selectExpr(
        "doc_id",
        "key",
        *(f"transform({k}, m -> named_struct('s', m.s, 'e', m.e)) AS {k}" for k in KINDS),
    )
    joined = slim.join(
        added, F.expr("doc_id <=> id AND key = other_key"), "left"
    ).selectExpr(
        "doc_id",
        *KINDS,
        *(
            f"array_sort(concat({k}, transform(filter(coalesce(added, array()),"
            f" m -> m.kind = '{k}'), m -> named_struct('s', m.s, 'e', m.e)))) AS all_{k}"
            for k in KINDS
        ),
    )
    return joined.selectExpr(
        "doc_id",
        *(f"cast(size({k}) AS bigint) AS n_{k}" for k in KINDS),
        f"sha2({span_texts({k: k for k in KINDS})}, 256) AS base_sha256",
        f"{span_texts({k: f'all_{k}' for k in KINDS})} AS spans",
    )


def mask_personal_data(documents: DataFrame) -> DataFrame:
    """The documents, with all columns, personal data in `text` replaced by [KIND].

    Base forms first, in the order of ``KINDS``, each in what the former has
    left; then, as [ID], the identifiers that the bootstrap finds in the same
    documents, where they stand between other characters than ASCII letters and
    digits. Null texts stay null, rows without personal data unchanged.
    """
    found = stored(scan(documents), "pii-spans")
    places = bootstrap(found).selectExpr("doc_id AS id", "key AS other_key", "start AS at")
    named = (
        identifiers(found)
        .selectExpr("doc_id", "key", "explode(words) AS w")
        .join(places, F.expr("doc_id <=> id AND key = other_key AND w.s = at"), "left_semi")
        .groupBy("doc_id", "key")
        .agg(F.collect_set("w.m").alias("words"))
        .toDF("_pii_id", "_pii_key", "_pii_words")
    )
    named = stored(named, "pii-named")
    rows = documents.selectExpr(
        "struct(*) AS d", f"{KEY} AS key", f"{clean_expr('cast(text AS string)')} AS t"
    )
    whole = r"concat('(?<![A-Za-z0-9])\\Q', replace(w, '\\E', '\\E\\\\E\\Q'), '\\E(?![A-Za-z0-9])')"
    for kind in KINDS:
        rows = rows.selectExpr("d", "key", "t", f"{cut_expr(kind, 't')} AS p").selectExpr(
            "d",
            "key",
            "CASE WHEN size(p) > 1 THEN array_join(transform(p, (x, i) -> CASE WHEN i % 2 = 1"
            f" AND exists(array(named_struct('m', x)), m -> {VALID[kind]})"
            f" THEN '[{kind.upper()}]' ELSE x END), '') ELSE t END AS t",
        )
    joined = rows.join(named, F.expr("d.doc_id <=> _pii_id AND key = _pii_key"), "left")
    masked = joined.selectExpr(
        "d",
        "CASE WHEN _pii_words IS NULL THEN t ELSE aggregate("
        "array_sort(_pii_words, (a, b) -> length(b) - length(a)), t,"
        f" (a, w) -> regexp_replace(a, {whole}, '[ID]')) END AS t",
    )
    # The marks that cleaning takes out come back where nothing was replaced.
    same = f"CASE WHEN t = {clean_expr('cast(d.text AS string)')} THEN cast(d.text AS string) ELSE t END AS text"
    return masked.selectExpr(
        *(same if c == "text" else f"d.`{c.replace('`', '``')}`" for c in documents.columns)
    )

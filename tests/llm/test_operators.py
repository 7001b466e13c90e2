"""The operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rowloom.llm import (
    bpe,
    decontaminate,
    language,
    licenses,
    main_text,
    near_dup,
    pii,
    quality,
    token_store,
    warc,
)
from rowloom.llm.common import words_of
from rowloom.session import work_folder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    "",
    " ",
    "a",
    "One two",
    "x " * 3000,
    "é\n\n\tÜber 日本語 🙂 \x1c\x85 é",
    "a" * 3000,
    "﷐ a@b.c﷐d@e.f",
    "don't 's 'S  IT'S",
]


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, k: int = 5) -> Counter:
    w = words(text)
    if 0 < len(w) < k:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def overlap(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def odd_documents(spark, more=()):
    """Null ids and texts, repeated rows, columns with clashing names."""
    rows = [(i, t, "w", 1) for i, t in enumerate([*ODD, *more])]
    rows += [(100, None, None, None), (None, "null id " * 20, "x", 2), (0, "", "w", 1), (0, "", "w", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, key int")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_word_hashes_tell_words_apart():
    rows = ["the cat THE", "", None, "cat", "thecat the"]
    hashes, first = words_of(pa.array(rows))
    assert np.diff(first).tolist() == [len(words(r)) for r in rows]
    flat = [w for r in rows for w in words(r)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


# 1: benchmark passages


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 16, 31, 33, 60, 90, 300)]
    rows = []
    for i, item in enumerate(items):
        w = item.split()
        noise = rng.choices(vocabulary, k=120)
        rows.append((i, " ".join(noise[:50] + w + noise[50:])))
        rows.append((100 + i, " ".join(noise[:7] + w[: len(w) // 2] + noise)))
        if len(w) > 50:
            changed = [*w]
            changed[3] = "other"
            rows.append((200 + i, " ".join(noise[:9] + changed)))
    want = set()
    for doc, text in rows:
        w = words(text)
        for i, item in enumerate(items):
            n, k = len(item.split()), min(5, len(item.split()))
            if any(
                overlap(shingles(" ".join(w[a : a + n]), k), shingles(item, k)) >= 0.8
                for a in range(max(1, len(w) - n + 1))
            ):
                want.add((doc, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_passages(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_neighbours_cover_the_radius():
    rng = np.random.default_rng(3)
    group = decontaminate.Class(20, 5)
    group.bound = -1
    group.prints = [int(x) for x in rng.integers(0, 1 << 32, 20)]
    group.close()
    prints = []
    for p in group.prints:
        for _ in range(50):
            bits = rng.choice(32, decontaminate.RADIUS, replace=False)
            prints.append(p ^ int(sum(1 << int(b) for b in bits)))
    at, which = group.candidates(np.array(prints, np.uint32), np.zeros(len(prints) + 20, np.int64))
    assert {(i, i // 50) for i in range(len(prints))} <= set(zip(at.tolist(), which.tolist()))


def test_passages_just_above_the_threshold(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, rows = [" ".join(["again"] * 12 + rng.choices(vocabulary, k=6))], []
    rows.append((0, "x y " + items[0].replace("again ", "", 1) + " z"))
    for i in range(1, 300):
        w = rng.choices(vocabulary, k=rng.randint(50, 55) if i % 3 else 15)
        items.append(" ".join(w))
        noise = rng.choices(vocabulary, k=40)
        if i % 3 == 0:
            rows.append((i, " ".join(w[:14])))  # the item less a word and nothing else
        else:
            at = rng.randrange(8, len(w) - 8)
            w[at : at + 1] = [["other"], [], [w[at], "more"]][i % 7 % 3]
            rows.append((i, " ".join(noise[:20] + w + noise[20:])))
    want = {}
    for (doc, text), item in zip(rows, items):
        w, n = words(text), len(words(item))
        best = max(
            overlap(shingles(" ".join(w[max(a, 0) : a + n])), shingles(item))
            for a in range(5 - n, len(w) - 4)
        )
        if best >= 0.8:
            want[doc] = best
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_passages(docs, bench).collect()
    assert len(want) == 300
    assert {r["doc_id"]: r["similarity"] for r in found} == pytest.approx(want)
    assert all(r["doc_id"] == r["item_id"] for r in found)


def test_benchmarks_in_parts_give_the_same(spark, folder, docs, monkeypatch):
    """Parts are found one after the other, and drop the same documents."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")

    def both():
        found = decontaminate.find_passages(docs, benchmark)
        return Counter(map(tuple, found.collect())), sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark).collect())

    whole = both()
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 3_000)
    assert decontaminate.parts_of(benchmark) > 2
    assert both() == whole and whole[0]


def test_passages_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 20)], "item_id long, text string")
    found = decontaminate.find_passages(odd_documents(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(4, 3)}
    assert decontaminate.find_passages(empty_documents(spark), bench).count() == 0
    assert decontaminate.find_passages(odd_documents(spark), bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd_documents(spark), bench).count() == 12


# 2: licenses


def test_licenses_equal_brute_force(spark):
    text = licenses.TEXTS["mit-text"].upper()
    cut = text.replace("TO ANY PERSON", "TO EACH AND ANY PERSON")
    rows = ["see the MIT License, mit-license", "cc by cc by", f"a b {text} c", f"x {cut} y", "mit"]
    docs = odd_documents(spark, rows)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    n = len(ODD)
    assert (got[n]["n_base"], got[n]["first_word"], got[n]["last_word"]) == (2, 2, 4)
    assert (got[n + 1]["base_labels"], got[n + 1]["n_base"]) == ("cc-by", 2)
    assert got[n + 2]["labels"] == got[n + 3]["labels"] == "mit-text"
    assert got[n + 4]["labels"] == "" and got[n + 4]["score"] == 0
    assert licenses.scan_licenses(docs).count() == docs.count()
    assert licenses.scan_licenses(empty_documents(spark)).count() == 0
    for r in docs.where("doc_id IS NOT NULL").collect():
        assert got[r["doc_id"]]["n_words"] == len(words(r["text"]))


def test_edited_license_texts(spark):
    rows, want = [], []
    for name, text in licenses.TEXTS.items():
        w = text.split()
        for i in range(len(w)):
            rows.append(" ".join(["so", *w[:i], "other", *w[i + 1 :], "it", "is"]))  # one word changed
            rows.append(" ".join(["so", *w[:i], "more", *w[i:], "it", "is"]))  # one put in
            rows.append(" ".join(w[:i] + w[i + 1 :]))  # one left out
        want += [name] * (len(rows) - len(want))
        half = len(w) // 2
        rows += [" ".join(w[:half]), " ".join(sorted(w)), " ".join(w[half:] + w[:half])]
        want += [""] * 3
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, name in enumerate(want):
        labels = set(got[i]["labels"].split(",")) - set(licenses.PHRASES.values()) - {""}
        assert labels == ({name} if name else set()), rows[i]
        assert not name or 0.8 <= got[i]["score"] <= 1


def test_randomly_edited_license_texts(spark):
    """Votes propose every text that a search of the whole document finds, edits of up to a fifth of the words."""
    rng = random.Random(6)
    rows = []
    for name, text in licenses.TEXTS.items():
        for _ in range(60):
            w = text.split()
            for _ in range(rng.randint(0, len(w) // 4)):
                at = rng.randrange(len(w))
                kind = rng.random()
                w[at : at + 1] = ["other"] if kind < 0.5 else [w[at], "more"] if kind < 0.75 else []
            around = rng.choices("this is a of the to license software free and x y z".split(), k=rng.choice([0, 5, 200]))
            at = rng.randint(0, len(around))
            rows.append(" ".join([*around[:at], *w, *around[at:]]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: set(r["labels"].split(",")) - set(licenses.PHRASES.values()) - {""} for r in licenses.scan_licenses(docs).collect()}
    texts = [licenses.Text(name, text) for name, text in licenses.TEXTS.items()]
    lost = found = 0
    for i, row in enumerate(rows):
        hashes, _ = licenses.words_of(pa.array([row]))
        want = {t.name for t in texts if licenses.share_in(hashes, t)}
        assert got[i] <= want
        found += len(want)
        lost += len(want - got[i])
    assert found > 300 and lost == 0


def test_base_license_places(spark, docs, texts):
    for r in licenses.scan_licenses(docs).collect():
        w = words(texts[r["doc_id"]])
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert r["first_word"] == min(places, default=None)
        assert r["last_word"] == max(places, default=None)
        assert r["base_labels"] == ",".join(sorted(labels))


# 3: languages

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(PIECES)
    table = np.random.default_rng(1).random((vocab.size + 1, 2)) * 1e-3
    for word in ("a", "hello", "où", "☃x"):
        marked = language.START + word

        def total(rest: str, lang: int) -> float:
            if not rest:
                return 1.0
            out = 0.0
            for n in range(1, len(rest) + 1):
                at = int(vocab.find(np.array([language.hash_text(rest[:n])], np.uint64))[0])
                p = table[at, lang] if at < vocab.size else language.UNKNOWN if n == 1 else 0.0
                out += p * total(rest[n:], lang) if p else 0.0
            return out

        got = language.word_scores(pa.array([word]), vocab, table)[0]
        assert np.allclose(got, [np.log(total(marked, i)) for i in range(2)])


def test_long_words_sum_all_segmentations(monkeypatch):
    """Words beyond LONGEST, across chunks, equal the plain forward pass of the whole word."""
    vocab = language.vocabulary(PIECES)
    table = np.random.default_rng(1).random((vocab.size + 1, 3)) * 1e-3
    table[-1] = 0
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshé☃", k=n)) for n in (38, 39, 40, 41, 56, 120)]
    monkeypatch.setattr(language, "CHUNK", 16)
    got = language.word_scores(pa.array(words), vocab, table)
    monkeypatch.setattr(language, "LONGEST", 1_000)
    assert np.allclose(got, language.word_scores(pa.array(words), vocab, table), rtol=1e-9)


def test_a_text_of_a_million_letters(spark):
    docs = spark.createDataFrame(
        [(i, f"wort der die und {i} " * 20, "de") for i in range(1, 40)]
        + [(100 + i, f"word the and of {i} " * 20, "en") for i in range(40)]
        + [(500, "thewordandof" * 90_000, None), (501, "no\u00a0break\u3000the and", None)],
        "doc_id long, text string, lang string",
    )
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, PIECES).collect()}
    assert got[500] == "en" and got[501] == "en"


def test_held_out_accuracy(docs):
    rows = language.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_languages_of_odd_tables(spark, docs):
    langs, table = language.learn(docs, PIECES)
    got = language.predict(odd_documents(spark).selectExpr("*", "'en' AS lang"), PIECES, langs, table)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 13 and by[0]["lang_pred"] == by[1]["lang_pred"] == by[100]["lang_pred"] == "und"
    assert by[None]["held_out"] is False and by[6]["lang_pred"] in langs
    assert language.identify(empty_documents(spark), PIECES).count() == 0


# 4: pages


def page(body: str) -> str:
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def test_main_text(spark):
    body = "<nav><a href=x>Home</a></nav><div class='post-1'><h1>T &amp; u</h1><p>One <b>two</b>\n x<p>Three</div>"
    rows = [(i, f"http://h/{i}", page(body.replace("One", f"One{i} long text here")), 1) for i in range(3)]
    rows += [(7, "http://h/7", page("<aside>" + "no " * 50 + "</aside><div class='post-2'><p>Yes</div><div><p>" + "other " * 30 + "</div>"), 1)]
    rows += [(8, None, None, 1), (None, "x", "", 1), (9, "y", "plain < text", 1), (10, "z", "<div>" * 2000 + "deep", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = {r["page_id"]: r for r in main_text.extract(pages).collect()}
    assert got[0]["text"] == "T & u\nOne0 long text here two x\nThree"
    assert got[7]["text"] == "Yes"  # the host's path wins over the longer text
    assert got[8]["text"] == got[None]["text"] == "" and got[8]["n_chars"] == 0
    assert got[9]["text"] == "plain < text" and got[10]["text"] == "deep"
    assert main_text.extract(pages.limit(0)).count() == 0


def test_main_text_of_split_articles(spark):
    def p(word):
        return f"<p>{(word + ' ') * 40}</p>"

    links = "<div class=x><a href=1>" + "link " * 9 + "</a></div>"
    bodies = {
        "a": "<article><h1>Title</h1><p>Lead</p><div class=body>" + p("one") + p("two") + "</div></article>",
        "b": "<div class=c><div class=chapter>" + p("one") * 2 + "</div><div class=appendix>" + p("two") + "</div></div>",
        "c": "<main><section class=s>" + p("one") + "</section><section class=t>" + p("two") * 3 + "</section></main>",
        "d": "<div class=post><h1>Title</h1><p>Lead</p><div class=body>" + p("one") + p("two") + "</div></div>" + links,
        "e": "<div class=one>" + p("one") + "</div>" + links + "<div class=two>" + p("two") + "</div>",
    }
    rows = [(10 * i + j, f"http://{h}/{j}", page(b)) for i, (h, b) in enumerate(bodies.items()) for j in range(3)]
    # a page that has a lead where the others of its host have none
    bare = "<div class=post><div class=body>" + p("one") + p("two") + "</div></div>"
    rows += [(100 + j, f"http://f/{j}", page(bare)) for j in range(3)] + [(103, "http://f/3", page(bodies["d"]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in main_text.extract(pages).collect():
        assert "one one" in r["text"] and "two two" in r["text"], r
        assert "link" not in r["text"]
        if r["page_id"] // 10 in (0, 3) or r["page_id"] == 103:
            assert r["text"].startswith("Title\nLead\n")


def test_main_text_with_titles_and_articles_in_main():
    """Titles and further articles within one main element are kept, teasers and boxes beside them are not."""
    part = "Some words of the article, with commas and more of them. "
    links = "".join(f'<a href="/{i}">Another story {i}</a> ' for i in range(8))

    def text(html):
        blocks = main_text.page_blocks(f"<html><body>{html}</body></html>")
        return main_text.take(blocks, main_text.best_path(blocks))

    body = f"<article class=story><p>{part * 8}</p></article>"
    assert text(f"<main><h1>TITLE</h1>{body}</main>") == f"TITLE\n{(part * 8).strip()}"
    both = f"<main><article class=intro><p>{part * 2}</p></article><article class=chapter><p>{part * 8}</p></article></main>"
    assert text(both) == f"{(part * 2).strip()}\n{(part * 8).strip()}"
    beside = f"<main><h1>TITLE</h1>{body}<article class=teaser>{links}</article><div class=box><p>{part}</p></div></main>"
    assert text(beside) == f"TITLE\n{(part * 8).strip()}"
    assert text(f"<main>{body}<div class=box><p>{part}</p></div></main>") == (part * 8).strip()
    content = f"<main><div class=content><p>{part * 8}</p></div><article class=teaser><p>{part}</p></article></main>"
    assert text(content).startswith((part * 8).strip())


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 30_000 + "</i>" * 30_000,
        "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000,
        "<b>" * 30_000 + "<p>x</p>" * 30_000,
        "<div>" * 30_000 + "<li>y" * 30_000,
        '<a "' * 30_001,
        "<p><b>" * 30_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_text.page_blocks(page)
    assert time.process_time() - start < 5


def test_blocks_equal_a_plain_reader():
    """Generated pages of blocks whose texts a plain reader finds by their tags alone."""
    rng = random.Random(8)
    for _ in range(200):
        blocks = [" ".join(rng.choices(["word", "other", "more &amp; less", "é"], k=rng.randint(5, 30))) for _ in range(rng.randint(1, 9))]
        inner = ""
        for b in blocks:
            tag = rng.choice(["p", "h2", "li", "blockquote", "pre"])
            words = b.split(" ")
            at = rng.randrange(len(words))
            words[at] = f"<b>{words[at]}</b>"
            inner += f"<{tag}>" + rng.choice([" ", "\n\t"]).join(words) + rng.choice([f"</{tag}>", f"</{tag}>\n"])
        noise = "<nav><a href=x>Home</a></nav>", "<script>var a = '<p>no</p>';</script>", "<footer>legal</footer>", "<!-- <p>no</p> -->"
        page = "<html><body>" + rng.choice(noise) + f"<article>{inner}</article>" + rng.choice(noise) + "</body></html>"
        got = main_text.take(main_text.page_blocks(page), None)
        assert got == "\n".join(html.unescape(b) for b in blocks)


def test_main_text_in_wrappers(spark):
    text = "<p>" + "story " * 60 + "</p><p>" + "end " * 30 + "</p>"
    inside = "<div class=post>" + text + "<div class=comments><p>" + "junk " * 5 + "</p></div></div>"
    around = "<nav><a href=x>junk</a></nav>{}<footer>junk</footer>"
    names = ["content has-sidebar", "no-sidebar", "ad-free", "search-result", "with-comments", "widget"]
    bodies = [f"<div class='{n}'>{inside}</div>" for n in names]
    bodies += [f"<form action=x>{inside}</form>", f"<div id=popup><form>{inside}</form></div>"]
    bodies += [f"<aside><article>{text}</article></aside>", f"<div class='page hidden'>{inside}</div>"]
    bodies += [  # what is beside an article stays out, however long
        f"<article>{text}</article><div class=comments>" + "<article><p>" + "junk " * 900 + "</article></div>",
        f"<div>{text}</div><div class=comments>" + "<p>junk " * 900 + "</div>",
    ]
    rows = [(i, None, page(around.format(b))) for i, b in enumerate(bodies)]
    rows.append((99, None, page("<nav>only</nav>")))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in main_text.extract(pages).collect():
        if r["page_id"] == 99:
            assert r["text"] == "only"
        else:
            assert "story story" in r["text"] and "end end" in r["text"], r
            assert "junk" not in r["text"], r


# 5: personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_x@d.e", "x@y..z w@q.r.s.", "a@b.c@d.e f@g.h", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.255",
    "4111 1111 1111 1111 x 4111-1111-1111-1111-", "+1 (555) 123-4567 +12345678+1 2",
    "é 4111111111111111 é a.b@c-d.e-f.g", "a@b.", "@b.c", "+1", "1 " * 500, "a@" + "b." * 500 + "c",
    "1." * 900, "+1" + "-1" * 500, " ".join(f"u{i}@x.com" for i in range(200)),
]


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text: str) -> list[str]:
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").unionByName(
        odd_documents(spark, TRICKY).selectExpr("doc_id + 100000 AS doc_id", "text")
    )
    text_of = {r["doc_id"]: (r["text"] or "").replace("﷐", " ") for r in rows.collect()}
    got = pii.find_personal_data(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        want = base_spans(text_of[r["doc_id"]])
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in FORMS] == [sum(w.startswith(k) for w in want) for k in FORMS]


def test_contexts_find_other_identifiers(spark):
    # eight seeds teach the pattern "customer-ip"; the ninth value is no valid address
    rows = [(i, f"the customer-ip 10.0.0.{i} was seen") for i in range(8)]
    rows += [(50, "the customer-ip 999.1.2.3 was seen"), (51, "version 999.1.2.3 of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got[50] == "ip:16:25" and got[51] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert masked[50] == "the customer-ip [ID] was seen" and masked[51] == rows[9][1]
    assert masked[3] == "the customer-ip [IP] was seen"


def test_masks_cover_whole_identifiers_only(spark):
    """A found identifier within a longer one stays, and so do marks where nothing is masked."""
    rows = [(i, f"the customer-ip 10.0.0.{i} was seen") for i in range(8)]
    rows += [(50, "the customer-ip 999.1.2.3 but not 7999.1.2.34 or 999.1.2.3x (999.1.2.3)")]
    rows += [(51, "\ufdd0 nothing \ufdd3 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert masked[50] == "the customer-ip [ID] but not 7999.1.2.34 or 999.1.2.3x ([ID])"
    assert masked[51] == rows[9][1]


def test_contexts_find_grouped_digits_and_new_patterns(spark):
    rows = [(1000 + i, f"now dial-me +1 (555) 123-4{i:03} please") for i in range(400)]
    rows += [(40, "now dial-me (017) 555-7713 at noon"), (41, "take (017) 555-7713 parts")]
    cards = [f"41111111{i:08}" for i in range(400)]
    cards = [c for c in cards if luhn(c)][:20]
    rows += [(50 + i, f"charge-card {c} today") for i, c in enumerate(cards)]
    rows += [(80, "charge-card 4111 1111 1111 1112 today")]
    # confident instances teach "reach-at", which stands beside no seed
    rows += [(100 + i, f"now dial-me 555-20{i:02} reach-at") for i in range(30)]
    rows += [(140, "so 555-9931 reach-at")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got[40] == "phone:12:26" and got[41] == ""
    assert got[80] == "card:12:31" and got[140] == "phone:3:11"
    masked = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert masked[40] == "now dial-me [ID] at noon" and masked[80] == "charge-card [ID] today"


def test_masking_keeps_rows_and_columns(spark):
    docs = odd_documents(spark, ["call +1 (555) 123-4567 or 555-1234-9", "4111-1111-1111-1111 a.b@c.de"])
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert by[len(ODD)] == "call [PHONE] or 555-1234-9"
    assert by[len(ODD) + 1] == "[CARD] [EMAIL]" and by[100] is None
    assert pii.find_personal_data(empty_documents(spark)).count() == 0


# 6: token files

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_token_files_round_trip(spark):
    docs = odd_documents(spark, ["<|endoftext|> x", "a<|startoftext|>b  c", "\x0bk\x0cl ΑΣ ½"])
    folder = work_folder(spark, "tokens-test")
    files = token_store.write_tokens(docs, WORD_BPE, folder)
    got = token_store.read_tokens(spark, folder, files).collect()
    tokenizer = token_store.tokenizer(WORD_BPE)
    ids = {
        r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for r in docs.collect()
    }
    before = 0
    for r in sorted(got, key=lambda r: (r["start"],)):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (before, len(own))
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        before += len(own)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    parts = [f["part"] for f in files.where("n_docs > 0").collect()]
    found = [token_store.TokenFile(folder, p).lookup(5) for p in parts]
    assert [x.tolist() for x in found if x is not None] == [ids[5]]


def test_token_files_of_empty_tables(spark):
    assert token_store.store_and_read(empty_documents(spark), WORD_BPE).count() == 0


def test_trained_dictionary_is_shared(spark, docs, texts):
    folder = work_folder(spark, "tokens-test")
    files = token_store.write_tokens(docs, WORD_BPE, folder).collect()
    assert sum(f["n_docs"] for f in files) == len(texts)
    system, place = token_store.shared_files(folder)
    with system.open_input_stream(f"{place}/dictionary") as f:
        assert len(f.read()) > 1024


# 7: archives


def test_archives_round_trip(spark):
    rows = [
        (1, "u\r\nX: 1", "é" * 600), (2, None, "é" * 600), (3, "http://a/é b", None),
        (None, "x", "q" * 2000), (5, "x", "q" * 2000), (6, "x", "q" * 2000), (6, "x", "q" * 2000),
        (7, "x", "\r\n\r\nWARC/1.1\r\n" * 3), (8, "y", "small"), (9, "y", "small"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS digest"
    )
    got = sorted(tuple(r) for r in warc.archive_and_read(pages).collect() if r[0] is not None)
    sha = {h: hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    best = {"é" * 600: 2, "q" * 2000: 6}
    want = []
    for p, _, h in rows:
        o = best.get(h, p)
        kind = ("response", None) if o == p else ("revisit", o)
        if p is not None:
            want.append((p, len((h or "").encode()), sha[h], *kind))
    assert got == sorted(want)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_single_records_and_plain_unpacking(spark, tmp_path):
    import zstandard

    rng = random.Random(1)
    rows = [(i, warc.record(i, "u", rng.randbytes(60_000), "d", None)) for i in range(20)]
    (tmp_path / "b").write_bytes(b"".join(warc.bundle(iter(rows), [])))
    found = warc.Bundle(str(tmp_path), "b")
    assert len(found.sizes) > 2 and found.lookup(99) is None
    assert found.lookup(13) == warc.parse(rows[13][1])
    with zstandard.ZstdDecompressor().stream_reader(
        (tmp_path / "b").open("rb"), read_across_frames=True
    ) as plain:
        assert plain.read() == b"".join(r for _, r in rows)


# 8: quality


def test_base_counts_equal_brute_force(spark, docs, texts):
    rows = quality.judge(docs, quality.Cutoffs({}, {})).collect()
    odd = odd_documents(spark, ["a b c a b c\n\n a b\na b c a b c", "#|x\ty&\r\n" * 40])
    rows += quality.judge(odd.selectExpr("doc_id + 100000 AS doc_id", "text"), quality.Cutoffs({}, {})).collect()
    text_of = texts | {r["doc_id"] + 100000: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = text_of[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert tuple(r[n] for n in quality.BASE) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])


def test_exact_binomial_bounds():
    for k, n, error in ((0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)):
        p = quality.upper_bound(k, n, error)
        assert abs(quality.binomial_tail(k, n, p) - error) < 1e-6
    assert quality.upper_bound(0, 0, 0.05) == quality.upper_bound(5, 5, 0.05) == 1.0


def test_cutoffs_keep_the_risk():
    rng = np.random.default_rng(2)
    n = 12_000
    rows = np.zeros((n, 3 + len(quality.RULES)))
    rows[:, 0], rows[:, 1], rows[:, 2] = np.arange(n) % 2, np.arange(n) % 3, rng.random(n) < 0.8
    rows[:, 3:] = rng.normal(size=(n, len(quality.RULES)))
    rows[:, 3] += 6 * (rows[:, 2] == 0)
    found = quality.fit_cutoffs(rows)
    good = rows[rows[:, 2] == 1]
    lost = np.zeros(len(good), bool)
    for (stratum, rule), cutoff in found.values.items():
        j = 3 + list(quality.RULES).index(rule)
        lost |= (good[:, 1] == stratum) & (good[:, j] > cutoff)
    assert lost.mean() <= quality.RISK
    assert all(np.isfinite(found.values[s, "symbols"]) for s in range(3))
    few = quality.fit_cutoffs(rows[:60])
    assert all(np.isinf(v) for v in few.values.values())  # too few to prove anything


def test_verdicts_equal_brute_force(spark):
    """Learned from Spark rows: each bound counts all held-out good documents, repeated rows too."""
    rng = random.Random(9)
    kinds = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(9_000):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(kinds) for _ in range(rng.choice([55, 60, 130])))
        if not good and rng.random() < 0.8:
            text += " #|#" * rng.randint(20, 40)
        rows += [(i, text)] * (2 if i % 50 == 0 else 1)
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = quality.learn(docs, labels)
    folds = docs.selectExpr("doc_id", "text", "pmod(xxhash64(text), 2) AS fold").collect()
    measured = quality.measure(pa.array([r["text"] for r in folds]))
    mark = dict(marks)
    table = np.array(
        [
            [r["fold"], measured["stratum"][n], mark[r["doc_id"]], *(measured[rule][n] for rule in quality.RULES)]
            for n, r in enumerate(folds)
            if not measured["base_failed"][n]
        ],
        float,
    )
    assert found == quality.fit_cutoffs(table)
    assert np.isfinite(found.values[0, "symbols"]) and found.bounds[0, "symbols"] > 0
    judged = quality.judge(docs, found).collect()
    assert Counter(map(tuple, quality.learn_and_judge(docs, labels).collect())) == Counter(map(tuple, judged))
    kept = {r["doc_id"]: k for r, k in zip(folds, found.verdict(measured).tolist())}
    assert all(r["kept"] == kept[r["doc_id"]] for r in judged)
    assert not all(kept.values()) and np.mean([kept[i] for i, g in marks if g]) > 0.95


def test_cutoffs_are_proposed_from_all_labels(spark, monkeypatch):
    """More documents of one stratum than were once proposed from, in many bins: as in memory."""
    monkeypatch.setattr(quality, "BIN", 500)
    rules = [
        f"(CASE WHEN id % 3 = 0 THEN {j} ELSE 0 END + pmod(xxhash64(id, {j}), {997 if j % 2 else 7})) / 100D AS `{rule}`"
        for j, rule in enumerate(quality.RULES)
    ]
    # the few documents with marks, and no others, are beyond one value
    rows = spark.range(60_000).selectExpr(
        "id AS doc_id", "id % 2 AS fold", "CASE WHEN id % 40 = 0 THEN 1L ELSE 0L END AS stratum", "false AS base_failed", *rules
    )
    rows = rows.withColumns({"marks": rows.marks + 20 * ((rows.doc_id % 15) == 6).cast("int")})
    labels = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    found = quality.learn_from(rows, labels)
    table = rows.join(labels, "doc_id").select("fold", "stratum", "quality", *quality.RULES).toPandas().to_numpy(float)
    assert found == quality.fit_cutoffs(table)
    assert math.isfinite(found.values[0, "marks"])
    seen = quality.grid_values(rows, "marks", {0: [1.0, 2.0], 1: []})
    for s in (0, 1):
        own = np.sort(table[table[:, 1] == s][:, 3 + list(quality.RULES).index("marks")])
        assert seen[s] == np.unique(np.quantile(own, np.linspace(0, 1, quality.GRID), method="lower")).tolist()


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    cutoffs = quality.learn(odd_documents(spark), labels)
    assert quality.judge(odd_documents(spark), cutoffs).count() == 13
    both = [quality.judge(odd_documents(spark), cutoffs), quality.learn_and_judge(odd_documents(spark), labels)]
    assert both[0].dtypes == both[1].dtypes
    assert Counter(map(tuple, both[0].collect())) == Counter(map(tuple, both[1].collect()))
    assert quality.learn_and_judge(empty_documents(spark), labels).count() == 0
    kept = quality.keep_good(odd_documents(spark), cutoffs)
    assert kept.columns == odd_documents(spark).columns
    assert quality.judge(empty_documents(spark), cutoffs).count() == 0


# 9: near copies


def brute_classes(text_of: dict) -> dict:
    sets = {i: shingles(t) for i, t in text_of.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            if overlap(s, sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("limit", [near_dup.FAMILY, 20_000])
def test_classes_equal_brute_force(docs, texts, limit):
    """Also with a limit beyond which families are dealt over several tasks."""
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs, limit=limit).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("limit", [near_dup.FAMILY, 4_000])
def test_a_large_group_of_near_copies(spark, limit):
    """Copies of one text at similarities around the threshold, which links some of them alone."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs, limit=limit).collect()}
    want = brute_classes(dict(rows))
    assert len(set(want.values())) > 5
    # Bands may miss a pair; a class then falls apart, and no two are ever joined wrongly.
    assert sum(got[i] != want[i] for i in want) <= 1


def test_large_bands_lose_nothing(docs, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET", 2)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_classes_of_members():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        for share in (0.02, 0.2, 0.9):
            linked = np.triu(rng.random((n, n)) < share, 1)
            linked |= linked.T
            label = near_dup.classes(n, lambda i, others: linked[i, others], int(rng.integers(n)))
            want = np.arange(n)
            for _ in range(n):
                for i in range(n):
                    want[i] = min([want[i], *want[linked[i]]])
            assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label)) == len(set(want))


def test_an_id_with_several_texts_loses_copies_only(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "z")
    rows = [(3, a, "first"), (7, near, "copy"), (7, b, "kept"), (7, b, "again"), (7, b.upper(), "same words"), (8, b, "late")]
    rows += [(9, None, "x"), (9, "", "y"), (9, None, "z"), (None, a, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    assert got == Counter([(3, a), (7, b), (9, ""), (9, ""), (None, a)])


def test_work_folders_are_removed(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(near_dup, "work_folder", lambda spark, label: f"{tmp_path}/{label}-{len(made)}-{made.append(1)}")
    made: list = []
    assert near_dup.near_duplicates(docs).count() == docs.count()
    left = sorted(p.name.split("-")[1] for p in tmp_path.iterdir())
    assert left == ["result"] and len(made) > 5


def test_chains_repeats_and_odd_rows(spark):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(12):  # a chain: each text is similar to its neighbours only
        rows.append((i, " ".join(base)))
        at = rng.randrange(len(base))
        base = base[:at] + [f"n{i}", f"m{i}"] + base[at + 1 :]
    rows += [(50, "one two"), (51, "ONE two"), (52, "one three"), (53, ""), (54, None), (None, "one two")]
    rows += [(60, "r " * 100), (61, "r " * 99), (62, "r " * 50), (50, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bands")
    got = near_dup.near_duplicates(docs)
    by = {r["doc_id"]: r["class_id"] for r in got.collect()}
    text_of = {i: t for i, t in rows if i is not None}
    assert by == brute_classes(text_of) | {None: None}
    assert got.count() == len(rows)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({by[i] for i in by if i is not None})
    assert near_dup.near_duplicates(empty_documents(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    hits = expected = 0
    for _ in range(200):
        values = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(1, 6, 60), rng.integers(0, 6, 60)
        items = np.concatenate([np.repeat(values, a), np.repeat(values, b)])
        s = near_dup.signatures(items, np.array([a.sum(), b.sum()]))
        hits += (s[0] == s[1]).mean()
        expected += np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(hits - expected) / 200 < 0.02


# 10: byte pairs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_pairs_round_trip(spark):
    long = "lorem ipsum, dolor's 12345  \n\n sit " * 6000 + "z" * 5000
    docs = odd_documents(spark, [long, "<|endoftext|>", "\t \n" * 400])
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    text_of = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = enc.encode_ordinary(text_of[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()
    encoded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect():
        assert bytes(r["decoded"]).decode() == text_of[r["doc_id"]]
    assert bpe.round_trip(empty_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_of_latin_texts_equal_the_library(monkeypatch):
    """Texts cut into words here, mixed with others, forgotten words included, have the library's ids."""
    rng = random.Random(2)
    rows = ["".join(chr(rng.randint(9, 0xFF)) for _ in range(8)) for _ in range(1500)]
    rows += ["".join(rng.choices("abc'sdtrelv \n\t!.1é", k=rng.randint(1, 25))) for _ in range(1500)]
    rows += ["", None, "<|endoftext|> a", "é日", "½ ²x", "a\x0bb\x0c'S don't''s", "long " * 300]
    monkeypatch.setattr(token_store, "CACHE", 500)
    monkeypatch.setattr(token_store, "LONG", 1000)
    encoder = token_store.Encoder(WORD_BPE)
    for i in range(0, len(rows), 400):
        part = rows[i : i + 400]
        values, counts = encoder.encode(pa.array(part, pa.string()))
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert counts.tolist() == list(map(len, want))
        assert values.tolist() == [x for ids in want for x in ids]

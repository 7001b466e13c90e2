"""Main text of web pages by consensus of their host.

Every page is read into blocks of text, each under a path of generalised tags
and classes (numbers in class names are dropped). A page's containers are
scored by the text and the links of the blocks right below them; from the best
one, a page goes up to the container that holds its article. Pages of a
host vote for that container's path; Spark adds the votes
up. A page is then read again and its text taken from containers on its host's
winning path. A page that has no such container, or a host whose pages don't
agree, goes by its own best container.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_pieces, stored

DEPTH = 64  # levels of elements that paths tell apart; those further down are one with them
BROADCAST_BYTES = 16 << 20  # of winning paths, up to which they are broadcast
AGREE = 0.5  # share of a host's votes that a path needs to win
MORE = 0.1  # of a container's score, that other text has for its ancestor to be taken

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NUMBER = re.compile(r"[0-9]+")

# Kinds of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr img".split()
)
# What never is text of a page, and what surrounds an article as a rule.
SKIP = set(
    "button select option script style textarea noscript iframe svg canvas template object audio"
    " video head title".split()
)
AROUND = set("nav header footer aside form menu dialog fieldset".split())
# Block elements that an open paragraph ends at.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}}
# Words in class names, ids and roles of what surrounds an article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|header|masthead|banner|footer|sidebar\w*|aside"
    r"|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe"
    r"|share|sharing|social|related|recommend\w*|comments?|replies|respond|discussion|disqus"
    r"|pagination|pager|widget\w*|search|login|signup|toolbar|skip|copyright|legal|hidden"
    r"|complementary|contentinfo|navigation|alert)(?:$|[\s_-])",
    re.I,
)
# Names that say what an element has, lacks or is the result of, not what it is.
ABOUT = re.compile(
    r"(?:^|(?<=\s))(?:has|have|no|not|non|with|without)[_-]\S*|\S*[_-](?:free|results?)(?=\s|$)", re.I
)
# What can hold more text than the article that it stands beside.
BESIDE = re.compile(r"comment|replies|respond|discussion|disqus|footer|related|recommend|sidebar", re.I)
ARTICLE = {"article", "main"}
MOST = 0.5  # of a page's text outside links, that an element must hold to count as a wrapper
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "path", "skip", "number", "noise", "article", "holder")

    def __init__(self, tag, path, skip, number, noise=(), article=None, above=None):
        self.tag, self.path, self.skip, self.number = tag, path, skip, number
        self.holder = above.holder if above and tag in LEAVES else self  # the container of text here
        self.noise = noise  # numbers of the elements around it that seem to surround an article
        self.article = article  # the same of the outermost article element that it lies in


def step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A generalised step of a path, whether the element seems to surround the
    article, and whether it may turn out to be a wrapper of it."""
    noise = tag in AROUND
    wrapper = tag in ("form", "fieldset")
    if not attributes:
        return tag, noise, wrapper
    names = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "class":
            names = sorted({NUMBER.sub("", n.lower()).replace("/", "|") for n in value.split()} - {""})
        if key in ("class", "id", "role"):
            value = ABOUT.sub("", value)
            if NOISE.search(value):
                wrapper = (wrapper or not noise) and not BESIDE.search(value)
                noise = True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            noise, wrapper = True, False
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            noise, wrapper = True, False
    if tag in ("body", "html"):
        noise = False
    return ".".join([tag, *names]), noise, wrapper


def page_blocks(page: str):
    """The blocks of a page that are not in what surrounds its article.

    An element that seems to surround the article does not if it is a wrapper
    that holds most of the page's text, or if it holds article elements of more
    text than stands outside all such elements. A page of nothing else has all
    its blocks.
    """
    blocks, wrappers = read_blocks(page)
    if any(b[4] for b in blocks):
        size = [len(b[0]) - b[1] for b in blocks]
        clean = sum(n for b, n in zip(blocks, size) if not b[4])
        article = any(b[5] == () for b, n in zip(blocks, size) if n and not b[4])
        held: dict[int, int] = {}
        inner: dict[int, int] = {}
        for b, n in zip(blocks, size):
            for e in b[4]:
                held[e] = held.get(e, 0) + n
            if b[5] == b[4]:
                for e in b[4]:
                    inner[e] = inner.get(e, 0) + n
        lifted = set()
        if not article:
            lifted = {e for e in held if e in wrappers and held[e] > MOST * sum(size)}
            lifted |= {e for e, n in inner.items() if n > clean}
        blocks = [b for b in blocks if lifted.issuperset(b[4])]
    if not blocks:
        blocks, _ = read_blocks(page, every=True)
    return blocks


def read_blocks(page: str, every: bool = False):
    """Blocks of a page in order, and the numbers of elements that may be wrappers.

    A block has its text, characters in links, path of its container, its
    number, the numbers of the elements around it that seem to surround the
    article, and those around the article element that it lies in, if any.

    The container of a block is the innermost open element that is neither
    inline nor the block itself (a paragraph, heading, list item or the like).
    Inline elements that surround the article give no text, unless `every`.
    The time is in proportion to the page, however broken it is.
    """
    stack = [Element("", "", False, 0)]
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    blocks_at = [0]  # places of the open elements that are not inline
    blocks: list[tuple] = []
    wrappers: set[int] = set()
    pieces: list[str] = []
    linked = links = 0
    count, at, end = 0, 0, len(page)

    def flush():
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                top = stack[-1]
                blocks.append(
                    (text, min(linked, len(text)), top.holder.path, top.holder.number, top.noise, top.article)
                )
            pieces.clear()
        linked = 0

    def text(raw: str):
        nonlocal linked
        if raw and not stack[-1].skip:
            clear = html.unescape(raw) if "&" in raw else raw
            pieces.append(clear)
            if links:
                linked += len(clear.strip())

    def last(*tags: str) -> int:
        """Where the innermost open element of these tags is, 0 if there is none."""
        return max(places[t][-1] if places.get(t) else 0 for t in tags)

    def pop(n: int):
        if blocks_at[-1] >= n:
            flush()
        for e in stack[n:]:
            places[e.tag].pop()
        del stack[n:]
        while blocks_at[-1] >= n:
            blocks_at.pop()

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                links = 0
            if tag == "p" and not last("p"):
                flush()
            found = last(tag)
            if found and not (tag in INLINE and blocks_at[-1] > found):
                pop(found)
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append("\n")
            elif tag == "hr":
                flush()
            continue
        if tag in ENDS_P and stack[blocks_at[-1]].tag == "p":
            pop(blocks_at[-1])
        if tag in CLOSES:
            found = last(*CLOSES[tag])
            if found > last(*SCOPE[tag]):
                pop(found)
        if tag not in INLINE:
            flush()
        name, noise, wrapper = step(tag, m.group(3))
        if tag == "a":
            links = 1
        above = stack[-1]
        count += 1
        same = tag in INLINE or len(stack) > DEPTH
        path = above.path if same else f"{above.path}/{name}"
        skip = above.skip or tag in SKIP or (noise and tag in INLINE and not every)
        around, article = above.noise, above.article
        if noise and tag not in INLINE and len(around) < DEPTH:
            around = (*around, count)
            if wrapper:
                wrappers.add(count)
        elif tag in ARTICLE and article is None:
            article = around
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks_at.append(len(stack))
        stack.append(Element(tag, path, skip, count, around, article, above))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return blocks, wrappers


LEAVES = INLINE | set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead figcaption ul ol dl table figure".split())


def score_paths(blocks) -> dict[str, float]:
    """Scores of the container paths of a page: text outside links, more for articles."""
    scores: dict[str, float] = {}
    for text, linked, path, *_ in blocks:
        own = len(text) - 2 * linked
        if any(s.partition(".")[0] in ARTICLE for s in path.split("/")):
            own *= 3
        scores[path] = scores.get(path, 0.0) + own
    return scores


def ancestors(path: str) -> list[str]:
    """The path and the paths above it, the lowest first."""
    out = []
    while path:
        out.append(path)
        path = path.rpartition("/")[0]
    return out


def rise(scores: dict[str, float], path: str, wide: bool) -> str:
    """The container that holds the article of which `path` holds a part.

    That is the outermost article element, or the main element around it if that
    has text of its own, such as a title, or further articles of ``MORE`` of its
    score; or else the innermost main element. Without these, it is the highest ancestor below the body that has text of
    its own, such as a title and a lead; and, if `wide`, the highest one that
    adds ``MORE`` to the score of what lies below.
    """
    above = ancestors(path)
    tags = [p.rpartition("/")[2].partition(".")[0] for p in above]
    if "article" in tags:
        at = len(tags) - 1 - tags[::-1].index("article")
        if "main" in tags[at:]:
            main = above[at + tags[at:].index("main")]
            own = sum(max(0.0, s) for p, s in scores.items() if inside(p, above[at]))
            more = sum(max(0.0, s) for p, s in scores.items() if article_below(p, main)) - own
            if scores.get(main, 0.0) > 0 or more > MORE * own:
                return main
        return above[at]
    if "main" in tags:
        return above[tags.index("main")]
    sums = dict.fromkeys(above, 0.0)
    for other, score in scores.items():
        if score > 0:
            for p in ancestors(other):
                if p in sums:
                    sums[p] += score
    top = path
    for p, tag in zip(above[1:], tags[1:]):
        own = tag not in ("body", "html") and scores.get(p, 0.0) > 0
        if own or wide and sums[p] - sums[top] > MORE * sums[top]:
            top = p
    return top


def direct_path(scores: dict[str, float]) -> str:
    return max(sorted(scores), key=lambda p: scores[p])


def best_path(blocks) -> str | None:
    scores = score_paths(blocks)
    return rise(scores, direct_path(scores), wide=True) if scores else None


def take(blocks, winner: str | None) -> str:
    """The text of the blocks in containers on the winning path or below it.

    Outside of article elements, containers of links beside the largest
    container are left out; beside articles in a main element, all that is
    neither its own text nor an article.
    """
    own = [b for b in blocks if winner is not None and inside(b[2], winner)]
    if own:
        winner = rise(score_paths(blocks), winner, wide=False)
    else:
        winner = best_path(blocks)
    own = [b for b in blocks if inside(b[2], winner)]
    scores = score_paths(own)
    if scores and not ARTICLE & {s.partition(".")[0] for s in winner.split("/")}:
        direct = direct_path(scores)
        own = [b for b in own if scores[b[2]] > 0 or inside(b[2], direct) or b[2] == winner]
    elif scores and article_below(direct_path(scores), winner):
        direct = direct_path(scores)
        own = [
            b
            for b in own
            if b[2] == winner or article_below(b[2], winner) and (scores[b[2]] > 0 or inside(b[2], direct))
        ]
    return "\n".join(b[0] for b in own)


def inside(path: str, winner: str) -> bool:
    return path == winner or path.startswith(winner + "/")


def article_below(path: str, main: str) -> bool:
    """Whether the path leads through an article element below a main element."""
    if main.rpartition("/")[2].partition(".")[0] != "main" or not path.startswith(main + "/"):
        return False
    return any(s.partition(".")[0] == "article" for s in path[len(main) + 1 :].split("/"))


HOST = "lower(coalesce(regexp_extract(cast(url AS string), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"


def winners(pages: DataFrame) -> DataFrame:
    """host, winner: the path that most of a host's pages vote for.

    Votes are added up by host and path map-side; a host of very many pages
    sends one row for each task and path.
    """

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        best = [best_path(page_blocks(h or "")) for h in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(best, pa.string())], ["host", "path"]
        )

    votes = map_pieces(
        pages.select("host", "html"), work, "host string, path string", text="html"
    ).where("path IS NOT NULL AND host <> ''")
    paths = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    return (
        paths.groupBy("host")
        .agg(
            F.max(F.struct("n", "path")).alias("top"),
            F.sum("n").alias("total"),
        )
        .where(F.col("top.n") > AGREE * F.col("total"))
        .selectExpr("host", "top.path AS winner")
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty html, or one without text, gives an empty text. Pages
    without a host go by themselves. Repeated rows give repeated results, null
    ids and addresses stay null, other columns are not read.
    """
    rows = pages.selectExpr(
        "cast(page_id AS bigint) AS page_id",
        "cast(url AS string) AS url",
        "cast(html AS string) AS html",
        f"{HOST} AS host",
    )
    agreed = stored(winners(rows), "text-winners")
    size = agreed.agg(F.sum(F.length("host") + F.length("winner") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else pages are shuffled by host, and Spark splits hot hosts
        agreed = F.broadcast(agreed)

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            take(page_blocks(h or ""), w)
            for h, w in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist())
        ]
        n = [len(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    joined = rows.join(agreed, "host", "left").select("page_id", "url", "html", "winner")
    return map_pieces(joined, work, "page_id long, url string, text string, n_chars long", text="html")

"""Main text of web pages by a minimum cut over their blocks."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements of HTML by what they do to text.
DROPPED = frozenset("script style noscript template head title iframe select option button textarea datalist".split())
#: What can stand in a head; anything else ends one left open.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_P_INSIDE = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
CHROME = frozenset("nav footer aside menu dialog search".split())
#: These hold a few fields or, on some pages, everything.
FORMS = frozenset("form fieldset".split())
#: An attribute by HTML's rules: a quote opens a value right after the equals sign only. One that is never closed opens none.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?>\s*+=\s*+(?>"([^"]*)"|'([^']*)'|([^\s>]*+)))?""")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(" + r"""(?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s>]*+))?)*+""" + r")(?:>|\Z)", re.S)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Class words of these say how the page is laid out.
WHOLE = frozenset("html body main article".split())
#: Words in class, id, role and aria-label that speak against what the element holds.
AWAY = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended recommendations share sharing social newsletter subscribe subscription signup login search cookie cookies consent notice notices alert popup modal overlay paywall pagination pager tags toolbar contentinfo complementary comment comments commentlist respond reply replies disqus discussion form copyright legal disclaimer skip".split())
#: What heads the comments of readers, with their number before or after it.
REPLIES = frozenset("comment comments reply replies response responses kommentar kommentare antwort antworten commentaire commentaires réponse réponses comentario comentarios respuesta respuestas".split())
HEADS_REPLIES = re.compile(r"(?:\d+\s+)?(\w+)\s*(?:\(\d+\)|:)?")
SPACE = re.compile(r"\s+")
RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


@dataclass
class Block:
    text: str
    parent: int
    linked: int
    heading: bool
    article: bool
    away: bool
    item: bool
    mark: int = 0  # the innermost element with a word of AWAY, form, or list of replies
    marks: float = 0  # how much all such elements around it say
    beside: bool = False  # outside the page's article, where it has one


def blocks_of(page: str) -> list[Block]:
    """The page's text in blocks, in page order: white space is one space, character references are decoded.

    Elements that hold no text of the page are left out with all they hold. Inline elements join what they stand between,
    a line break is white space, and block elements part it. End tags that HTML lets one leave out are supplied.
    """
    out: list[Block] = []
    # name, number, in an article, away from it, mark, and the same but the mark of the innermost block element
    stack: list[tuple] = [("", 0, False, False, 0, ("", 0, False, False))]
    open_: Counter[str] = Counter()
    marked: dict[int, int] = {}  # each marked element's next one outside
    wrappers: set[int] = set()  # those that may hold most of the page for all that they are
    parts: list[str] = []
    # replies: the element whose heading says that comments follow, that heading's rank, and the mark of what follows
    state = {"linked": 0, "a": 0, "number": 0, "dropped": 0, "replies": None}

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            name, number, article, away = stack[-1][5]
            heading, mark = name[:1] == "h" and name[1:].isdigit(), stack[-1][4]
            if heading and (not state["replies"] or name <= state["replies"][1]):
                m = HEADS_REPLIES.fullmatch(text)
                state["replies"] = None
                if m and m[1].lower() in REPLIES:
                    k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] < number)
                    state["number"] += 1
                    marked[state["number"]] = mark
                    state["replies"] = stack[k][1], name, state["number"]
            if state["replies"] and mark in (0, marked[state["replies"][2]]):
                mark = state["replies"][2]
            out.append(Block(text, number, min(state["linked"], len(text)), heading, article, stack[-1][3] or away, name in ("li", "td", "th", "dt"), mark))
        state["linked"] = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, number = stack.pop()[:2]
            if state["replies"] and state["replies"][0] == number:
                state["replies"] = None
            open_[name] -= 1
            state["dropped"] -= name in DROPPED
            state["a"] -= name == "a"

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        raw = page[at : m.start() if m else end]
        if stack[-1][0] == "head" and raw and not raw.isspace():
            close(len(stack) - 1)
        if raw and not state["dropped"]:
            text = html.unescape(raw)
            parts.append(text)
            state["linked"] += len(text) if state["a"] else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if stack[-1][0] == "head" and not m[1] and name not in HEAD:
            close(len(stack) - 1)
        if name == "br" or name == "wbr":
            if name == "br" and not state["dropped"]:
                parts.append(" ")
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0) if open_[name] else 0
            if name in BLOCKS and not state["dropped"]:
                flush()
            if k:
                close(k)
            continue
        if name in BLOCKS and not state["dropped"]:
            flush()
            if name in ENDS:
                ended, fence = ENDS[name]
                for k in range(len(stack) - 1, 0, -1) if any(open_[n] for n in ended) else ():
                    if stack[k][0] in fence:
                        break
                    if stack[k][0] in ended:
                        close(k)
                        break
            if name in NO_P_INSIDE:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCKS), 0) if open_["p"] else 0
                if k and stack[k][0] == "p":
                    close(k)
        if name in VOID:
            continue
        _, _, article, away, mark, holder = stack[-1]
        state["number"] += 1
        words, hidden = attributes_of(m[3])
        if name in FORMS or name not in WHOLE and not AWAY.isdisjoint(words):
            marked[state["number"]], mark = mark, state["number"]
            if name in FORMS or article:
                wrappers.add(mark)
        if name in ("article", "main"):
            article = True
        away = away or hidden or name in CHROME or name == "header" and not article
        if m[0].endswith("/>") and name not in BLOCKS:
            continue
        stack.append((name, state["number"], article, away, mark, (name, state["number"], article, away) if name in BLOCKS else holder))
        open_[name] += 1
        state["a"] += name == "a"
        state["dropped"] += name in DROPPED
        if name in RAW:
            ended_by = RAW[name].search(page, at)
            at = ended_by.start() if ended_by else end
    flush()
    weigh(out, marked, wrappers)
    return out


def attributes_of(text: str) -> tuple[list[str], bool]:
    """The words of a tag's class, id, role and aria-label, and whether its attributes hide the element."""
    words, hidden = [], False
    for name, *values in ATTRIBUTE.findall(text) if text and not text.isspace() else ():
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "aria-label"):
            words += re.split(r"[^a-z]+", value.lower())
        hidden = hidden or name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(NO_DISPLAY.search(value))
    return words, hidden


def weigh(blocks: list[Block], marked: dict[int, int], wrappers: set[int]) -> None:
    """Set what the marks around each block say: a mark says 1 less its element's share of the page's text, a form's, or one inside
    the article, 1 less twice the share: what holds half of the page is no form for a few fields."""
    named = any(b.article for b in blocks)
    for b in blocks:
        b.beside = named and not b.article
    if not marked:
        return
    held, marks = dict.fromkeys(marked, 0), {0: 0.0}
    for b in blocks:
        if b.mark and not b.away:
            held[b.mark] += len(b.text)
    for m in reversed(marked):
        if marked[m]:
            held[marked[m]] += held[m]
    whole = sum(len(b.text) for b in blocks if not b.away) or 1
    for m, outer in marked.items():
        share = held[m] / whole
        marks[m] = marks[outer] + (max(0.0, 1 - 2 * share) if m in wrappers else 1 - share)
    for b in blocks:
        b.marks = marks[b.mark]


def features(b: Block) -> list[float]:
    n = len(b.text)
    sentence = b.text[-1] in ".!?:;…\"'»”)"
    return [1, b.article, b.beside, b.away, (not b.article) * b.linked / n, b.article * b.linked / n, min(math.log1p(n), 7) / 7, b.heading, b.item, sentence, min(b.marks, 1.5), min(n / 200, 1), b.article and not b.away and not b.marks]


#: The labelled table's pages: after + a text of the article, after - another one (p paragraph, s sentence, h heading, i item, c
#: heading of replies).
PAGES = (
    "<header><a>-i</a></header><nav><ul><li><a>-i</a><li><a>-i</a></ul></nav><main><article><h1>+h</h1><p>+p<p>+p<ul><li>+i<li>+s</ul><p>+s</article></main><aside><h2>-h</h2><p>-p</aside><footer>-s</footer>",
    "<div id=menu><a>-i</a> <a>-i</a></div><div class=content><h2>+h</h2><p>+p</p><p>+p</p></div><div class=footer>-s</div>",
    "<div class=ad>-s</div><article class='post has-sidebar'><h1>+h</h1><p>+p<div class=share><a>-i</a></div><p>+p<p>+s</article><div class=comments><h3>-h</h3><p>-p<p>-s<p>-p</div>",
    "<body class='home has-sidebar'><div class=cookie-notice><p>-p</p></div><main><h1>+h</h1><p>+p<p>+p<blockquote>+s</blockquote></main><div class=sidebar><h3>-h</h3><ul><li><a>-i</a><li><a>-i</a></ul></div>",
    "<article><h1>+h</h1><p>+p<form><p>-s<p>-p</form><section id=discussion><h2>+h</h2><p>+p<p>+p</section></article><footer><p>-p<p>-s</footer>",
    "<div class='social-science article'><h1>+h</h1><p>+p<p>+p</div><div class=related><h3>-h</h3><p>-s<p>-s</div>",
    "<div class='layout with-sidebar'><article><h1>+h</h1><p>+p<table><tr><th>+i<th>+i<tr><td>+i<td>+i</table><p>+p</article><div class=widget><p>-p</div></div>",
    "<h1>+h</h1><p>+p<p>+s<p>+p<dl><dt>+i<dd>+s</dl><p><a>-i</a><p><a>-i</a>",
    "<body class=ad-free><ul><li><a>-i</a><li><a>-i</a><li><a>-i</a></ul><div><h2>+h</h2>+p<br>+s<p>+p</div><p class=copyright>-s",
    "<article class='post tag-news comments-open'><h1>+h</h1><p>+p<p>+s<p hidden>-p</article><div id=respond><h3>-h</h3><p>-s</div>",
    "<main><article><header><h1>+h</h1><p>+s</header><p>+p<div class=newsletter><p>-s<p>-p</div><p>+p<div class=promo>-s</div><h2>+h</h2><p>+p</article></main><nav><a>-i</a></nav>",
    "<div class=banner>-s</div><div class=page><div class=nav><a>-i</a><a>-i</a></div><div class=text><p>+p<p>+p<p>+p</div><div class=legal><p>-p</div></div>",
    "<article><h1>+h</h1><div class=menu-item-recipe><p>+p<p>+p<ol><li>+s<li>+s<li>+i</ol></div><p>+s</article><div class=ad>-p</div>",
    "<main id=content-menu><h1>+h</h1><p>+p<pre>+p</pre><p>+s</main><div role=complementary><p>-p<p>-s</div><footer>-i</footer>",
    "<form id=page><div id=top><a>-i</a> <a>-i</a></div><div id=content><h1>+h</h1><p>+p<p>+s<p>+p</div><footer>-s</footer></form>",
    "<form><main><h1>+h</h1><p>+p<fieldset><p>+p<p>+s</fieldset></main><nav><a>-i</a></nav></form>",
    "<article><h1>+h</h1><ul><li><a>+i</a><li><a>+i</a><li><a>+i</a><li><a>+i</a><li><a>+i</a></ul></article><nav><a>-i</a><a>-i</a></nav>",
    "<main><h1>+h</h1><p>+p<p><a>+s</a><p>+p<ol><li><a>+s</a><li><a>+i</a></ol></main><div><form>-i<fieldset>-s</fieldset></form></div>",
    "<article><h1>+h</h1><p>+p<p>+p</article><section><h3>-c</h3><p>-p<p>-s<p>-p</section>",
    "<article><h1>+h</h1><p>+p<p>+s</article><div><h3>-h</h3><p>-p<p>-s</div>",
    "<div><h1>+h</h1><p>+p<p>+p<p>+s</div><div><h2>-c</h2><div><p>-s</div><div><p>-p</div></div><footer>-s</footer>",
)
SIZES = {"p": (25, 90), "s": (4, 16), "h": (3, 9), "i": (1, 4)}


def labelled_blocks(copies: int = 6, seed: int = 5, pages: tuple[str, ...] = PAGES) -> list[tuple[Block, bool]]:
    """The labelled table: each page filled with invented words `copies` times, and of its blocks which are the article's."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "mi", "lo", "ka", "su", "re", "ti")) for _ in range(r.randint(1, 4)))
    for page in pages * copies:
        wanted: dict[str, bool] = {}

        def fill(m: re.Match, wanted: dict[str, bool] = wanted) -> str:
            if m[2] == "c":
                text = f"{r.randint(1, 999)} {r.choice(sorted(REPLIES))}"
            else:
                text = " ".join(word() for _ in range(r.randint(*SIZES[m[2]])))
            text += "." if m[2] in "ps" else ""
            wanted[text] = m[1] == "+"
            return text

        blocks = blocks_of(re.sub(r"([+-])([pshic])(?![a-z])", fill, page))
        out += [(b, all(keep for text, keep in wanted.items() if text in b.text)) for b in blocks]
    return out


#: No weight is larger: no single feature, class words least of all, decides alone.
LARGEST = 6.0


@functools.cache
def weights() -> np.ndarray:
    """Logistic regression over the features of the labelled table's blocks, its weights bounded."""
    return fit(labelled_blocks())


def fit(table: list[tuple[Block, bool]]) -> np.ndarray:
    x, y = np.array([features(b) for b, _ in table], float), np.array([keep for _, keep in table], float)
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w = np.clip(w + 1.5 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - 2e-4 * w), -LARGEST, LARGEST)
    return w


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; capacities are integers, edges go both ways.

    Blocking flows on level graphs. Each node's direct path from source to sink is taken first.
    """
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for v, (a, b) in enumerate(zip(source, sink, strict=True)):
        if a > b:
            add(s, v, a - b, 0)
        elif b > a:
            add(v, t, b - a, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
            while at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1
                continue
            path.append(head[v][at[v]])
            v = to[path[-1]]


#: Smoothness between neighbours on the page, and more between blocks of one parent element; costs are in hundredths.
NEXT, SIBLING, SCALE = 40, 60, 100


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    z = np.clip(np.array([features(b) for b in blocks]) @ weights(), -12, 12)
    costs = np.rint(SCALE * np.logaddexp(0, np.stack([z, -z]))).astype(int).tolist()
    last: dict[int, int] = {}
    edges = []
    for k, b in enumerate(blocks):
        same_side = k and (blocks[k - 1].away, blocks[k - 1].mark) == (b.away, b.mark)
        if k:
            edges.append((k - 1, k, NEXT if same_side else NEXT // 8))
        if b.parent in last and last[b.parent] != k - 1:
            edges.append((last[b.parent], k, SIBLING))
        elif b.parent in last and same_side:
            edges[-1] = (k - 1, k, NEXT + SIBLING)
        last[b.parent] = k
    kept = min_cut(costs[0], costs[1], edges)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page's main text.

    Blocks are the nodes. The classifier's costs of calling a block content or boilerplate are its capacities to the two
    terminals; neighbours on the page and blocks of one parent pull to one side. The minimum cut labels all blocks at once. The
    classifier is learned from a small labelled table of blocks; that an element's class names an advert, a menu or the like is
    one feature of many, weighed by how much of the page the element holds.

    A null or empty page has an empty text; null ids and urls stay; repeated pages give a row each; an empty table none.
    Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")

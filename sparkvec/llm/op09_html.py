"""Main text of HTML pages: flat text blocks, judged by their own and their neighbours' word counts and link densities.

A page is read into flat blocks at block-level tags, with tags, attributes and comments ended as the HTML standard has it. Only what is
never text (scripts, styles, form controls, drawings) gives no block. Each block has its number of words, the share of
them inside links, the same of the block before and after, whether it stands in the page's article, beside it, or on a page
without one, how much the elements around it say that it is furniture (0 to 3, by tag, role, class and id), what kind of element it
is, and its share of words that notices use. A decision tree keeps or leaves each block; kept blocks are joined in page order by one newline.

The tree is trained on the blocks of labelled pages that `layouts` lays out: 1,500 news pages, blogs, manuals, forums and forms.

The article is what article and main elements hold, or containers that say so; a page whose such elements hold less than a third of the
words outside links and furniture counts as one without. A form, or a container with the name of furniture, says nothing about a page that it holds most of.

A null or empty page gives the empty text. Unclosed and cut-off tags are taken as browsers do: an unfinished tag is dropped,
an unclosed script or style runs to the end. Repeated rows each give a row; an empty table gives an empty one; other columns
are not read. Pages are narrow per row, so no shuffle is needed; no size of page or number of blocks is capped, and reading takes time in
proportion to a page's length.
"""

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import by_bytes, texts
from sparkvec.session import table

#: A value is quoted, or runs to white space or >; quotes elsewhere mean nothing.
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
ATTRIBUTES = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{VALUE}?+)?+|=)*+"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(>|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>", re.S)
ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({VALUE})?+)?+")
#: Elements whose content is no markup, and others whose content is not running text.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
APART = frozenset("template svg object select datalist button canvas audio video".split())
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
EDGES = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in APART}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
IN_HEAD = frozenset("base link meta script style title noscript template".split())
#: A start tag of the first kind ends the innermost open one of the second, unless one of the third is in between.
ENDED_BY = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}

#: How much a tag or role around a block speaks for furniture.
TAGS = {"nav": 2, "footer": 2, "aside": 2, "menu": 2, "dialog": 2, "search": 2, "form": 2, "header": 1}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A class or id names furniture if one of its parts between - and _ is a word of these sets, and the others are of these or neutral.
WEAK = frozenset("breadcrumb breadcrumbs header masthead menu notice related toolbar".split())
STRONG = frozenset("ad ads adsense advert advertisement advertising adverts aside banner consent cookie cookies copyright footer gdpr modal nav navbar navigation newsletter overlay pagination popup popular promo promoted promotion share sharing sidebar signup social sponsor sponsored subscribe subscription trending".split())
COMMENTS = frozenset("comment comments discussion discussions disqus feedback reactions replies reply respond responses review reviews".split())
NEUTRAL = frozenset("area bar body bottom box block container content form global group holder inner item left links list main message most nested page panel primary reader readers read right row secondary section site slot thread top unit user users widget wrap wrapper".split())
ARTICLE = frozenset("article articlebody article-body article-content article-text entry-content post-body post-content story-body".split())
#: Words that notices, offers and buttons use.
CUES = frozenset("accept advertisement advertisements click consent cookie cookies download follow login newsletter policy privacy settings share sign sponsored subscribe tweet".split())
KINDS = {"p": 2, "pre": 2, "blockquote": 2, "figcaption": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "li": 1, "td": 1, "th": 1, "dd": 1, "dt": 1}


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    in_article: bool
    kind: int
    box: int


class Place(NamedTuple):
    tag: str
    in_article: bool
    comments: bool  # furniture that an article inside doesn't end
    box: int  # the innermost element around that speaks for furniture, -1 for none


class Box:
    """An element that speaks for furniture, and what is found in it."""

    __slots__ = ("doubtful", "hint", "parent", "titled", "words")

    def __init__(self, parent: int, hint: int, doubtful: bool):
        self.parent, self.hint, self.doubtful, self.words, self.titled = parent, hint, doubtful, 0, False


def layouts(seed: int, pages: int) -> Iterator[str]:
    """Labelled pages: text of the article is made of words that begin with k, all else of words that begin with x."""
    rng = random.Random(seed)

    def say(letter: str, least: int, most: int, cues: float = 0.0) -> str:
        return " ".join(rng.choice(sorted(CUES)) if i and rng.random() < cues else f"{letter}{rng.randrange(99)}" for i in range(rng.randint(least, most)))

    def links(tag: str, n: int, letter: str = "x") -> str:
        inner = "li" if tag in ("ul", "ol") else "span"
        return f"<{tag}>" + "".join(f'<{inner}><a href="/{i}">{say(letter, 1, 5)}</a></{inner}>' for i in range(n)) + f"</{tag}>"

    def paragraph() -> str:
        size = rng.choice([(1, 3), (4, 15), (16, 60), (60, 200)])
        text = say("k", *size)
        return rng.choice(["<p>{}</p>"] * 6 + ["<div>{}</div>"] * 2 + ["<p>{} <a href=x>k1 k2</a></p>", '<p>k1</p><p><a href="a">{}</a></p>', "<p>k2 k3 <a href=x>{}</a></p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>k3 k4</li></ul>", "<pre>{}</pre>", '<div class="related"><p>k7 k8 k9 k1 k2 k3 k4 k5 k6 {}</p></div>', '<p class="menu">k7 k8 k9 k1 k2 k3 k4 k5 k6 {}</p>']).format(text)

    def furniture() -> str:
        name = rng.choice(["ad", "sidebar", "cookie-notice", "newsletter-signup box", "social-share", "site-footer", "promo", "most-popular", "nav menu", "site-banner"])
        return rng.choice([
            lambda: f'<div class="{name}"><h3>{say("x", 1, 4)}</h3><p>{say("x", 1, 60)}</p></div>',
            lambda: f'<div class="{name}">{say("x", 1, 40)}</div>',
            lambda: f"<aside>{links('ul', 4)}<p>{say('x', 5, 50)}</p></aside>",
            lambda: f'<section class="{rng.choice(["comments", "discussion", "user-reviews", "replies"])}"><h2>{say("x", 1, 3)}</h2><article><p>{say("x", 3, 90)}</p></article></section>',
            lambda: f"<form action=x><label>{say('x', 1, 4)}</label><p>{say('x', 3, 40)}</p></form>",
            lambda: f'<div role="{rng.choice(sorted(ROLES))}"><p>{say("x", 1, 40)}</p></div>',
        ])()

    def unnamed() -> str:
        """Furniture that no name gives away."""
        return rng.choice([
            lambda: links("ul", rng.randint(3, 9)),
            lambda: f"<div>{links('div', rng.randint(3, 6))}</div>",
            lambda: f'<div><a href="/x"><h2>{say("x", 1, 4)}</h2><h2>{say("x", 1, 4)}</h2></a></div>',
            lambda: f'<div class="{rng.choice(sorted(WEAK))}">{links("ul", 3)}</div>',
            lambda: f'<div class="z{rng.randrange(9)}">{say("x", 8, 30, 0.3)}</div>',
            lambda: f'<div class="z{rng.randrange(9)}"><a href=y>{say("x", 1, 4, 0.4)}</a> <a href=y>{say("x", 1, 3, 0.4)}</a></div>',
            lambda: f"<div>x1 {say('x', 1, 2, 1.0)}</div>",
            lambda: f'<div class="most-read">{links("ul", rng.randint(1, 6))}</div>',
        ])()

    for _ in range(pages):
        title = f"<h1>{say('k', 1, 12)}</h1>"
        body = title if rng.random() < 0.6 else f"<div>{say('k', 1, 6)}</div>" if rng.random() < 0.3 else f"<header>{title}<p>{say('k', 6, 25)}</p></header>"
        kind = rng.random()
        for _ in range(rng.randint(1, 9)):
            body += f"<h2>{say('k', 1, 6)}</h2>" * (rng.random() < 0.2) + paragraph()
            if rng.random() < 0.25:
                body += furniture() if rng.random() < 0.6 or kind >= 0.5 else unnamed()
        head = rng.choice([f'<header class="site-header"><a href="/">{say("x", 1, 3)}</a></header>', f"<header>{say('x', 1, 3)}{links('ul', 4)}</header>", f"<div>{say('x', 1, 3)}</div>{links('ul', 6)}", ""])
        head += rng.choice([f"<nav>{links('ul', 5)}</nav>", links("ul", 6), unnamed(), ""])
        tail = "".join(rng.choice([furniture, unnamed])() for _ in range(rng.randint(0, 3))) + rng.choice([f"<footer>{say('x', 1, 60)}</footer>", ""])
        if kind < 0.5:
            middle = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>', '<div id="page"><article>{}</article></div>']).format(body)
        else:
            middle = rng.choice(["{}", '<div class="page">{}</div>', '<div class="content"><div>{}</div></div>', "<td>{}</td>"]).format(body)
        page = head + middle + tail
        if rng.random() < 0.1:
            page = f'<form id="aspnetForm">{page}</form>'
        yield f"<body>{page}</body>" if rng.random() < 0.95 else f"<p>{say('k', 1, 3)}</p>"


def examples(seed: int, pages: int) -> list[tuple]:
    """Features and label of every block of the layouts."""
    out = []
    for page in layouts(seed, pages):
        found = blocks(page)[0]
        out += [(*f, int(b.text[0] == "k")) for b, f in zip(found, features(page), strict=True)]
    return out


def train(rows: list[tuple], depth: int = 12, least: int = 8) -> tuple:
    """A decision tree by Gini impurity: nested (feature, threshold, below, above), or a label."""

    def grow(x: np.ndarray, y: np.ndarray, left: int) -> tuple | int:
        if left == 0 or y.min() == y.max() or len(y) < 2 * least:
            return int(y.mean() >= 0.5)
        best = (np.inf, 0, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, up = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v) + 1)
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(n[at] >= least) & (len(v) - n[at] >= least)]
            if len(at):
                p, q = up[at] / n[at], (up[-1] - up[at]) / (len(v) - n[at])
                gini = n[at] * p * (1 - p) + (len(v) - n[at]) * q * (1 - q)
                i = int(gini.argmin())
                best = min(best, (float(gini[i]), f, float((v[at[i]] + v[at[i] + 1]) / 2)))
        _, f, t = best
        if np.isinf(best[0]):
            return int(y.mean() >= 0.5)
        low = x[:, f] < t
        return f, t, grow(x[low], y[low], left - 1), grow(x[~low], y[~low], left - 1)

    a = np.array(rows, float)
    return grow(a[:, :-1], a[:, -1], depth)


@lru_cache(maxsize=1)
def trained() -> tuple:
    """The tree of 1,500 labelled pages."""
    return train(examples(1, 1500))


def judge(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] < t else high
    return tree


def attributes(raw: str) -> dict[str, str]:
    """Names and values, the first of each name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        v = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(v[1:-1] if v[:1] in "\"'" and v[:1] == v[-1:] and len(v) > 1 else v))
    return out


def named(name: str) -> int:
    """How much a class or id speaks for furniture: 0 if it names something else, 1 or 2, 3 for reader comments."""
    parts = {p for p in re.split(r"[-_]+", name.lower()) if p and not p.isdigit()}
    if not parts <= WEAK | STRONG | COMMENTS | NEUTRAL:
        return 0
    return 3 if parts & COMMENTS else 2 if parts & STRONG else 1 if parts & WEAK else 0


def entered(tag: str, raw: str, at: Place, boxes: list[Box]) -> Place:
    """The place inside a new element; what speaks for furniture is added to boxes."""
    a = attributes(raw) if "=" in raw else {}
    names = [*a.get("class", "").split(), *a.get("id", "").split()]
    role = a.get("role", "").lower()
    by_name = max(map(named, names), default=0) if tag not in ("html", "body", "main") else 0
    comments = at.comments or tag == "aside" or by_name == 3
    article = tag in ("article", "main") or role in ("article", "main") or any(n.lower() in ARTICLE for n in [*names, a.get("itemprop", "")])
    if article and not comments and not by_name:
        if at.box >= 0:
            boxes[at.box].titled = True
        return Place(tag, True, False, -1)
    by_tag = 0 if tag == "header" and at.in_article else TAGS.get(tag, 0)
    hint = max(by_name, by_tag, 2 if role in ROLES else 0)
    if not hint:
        return Place(tag, at.in_article, comments, at.box)
    boxes.append(Box(at.box, hint, tag == "form" or by_tag < 2))
    return Place(tag, at.in_article, comments, len(boxes) - 1)


def closed(tag: str, page: str) -> dict[int, int]:
    """Where elements of this tag end, by where their start tags end; those that are never closed are not there."""
    out, open_ = {}, []
    for e in EDGES[tag].finditer(page):
        if not e[1]:
            if not e[0].endswith("/>"):
                open_.append(e.end())
        elif open_:
            out[open_.pop()] = e.end()
    return out


def blocks(page: str) -> tuple[list[Block], list[Box]]:
    """The page's flat blocks in order, and the elements around them that speak for furniture."""
    out: list[Block] = []
    boxes: list[Box] = []
    places: list[Place] = []
    outside = Place("", False, False, -1)
    open_tags: Counter[str] = Counter()
    ends_of: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    linked: list[str] = []
    link: int | None = None  # open places where the link began
    at = 0

    def close() -> None:
        if parts:
            here = places[-1] if places else outside
            words = "".join(parts).split()
            if words:
                n = min(len(words), len("".join(linked).split()))
                out.append(Block(" ".join(words), len(words), n, here.in_article, KINDS.get(here.tag, 0), here.box))
                if here.box >= 0:
                    boxes[here.box].words += len(words) - n
                    boxes[here.box].titled |= here.tag == "h1"
            parts.clear()
            linked.clear()

    def leave(i: int) -> None:
        nonlocal link
        close()
        for p in places[i:]:
            open_tags[p.tag] -= 1
        del places[i:]
        if link is not None and link > i:
            link = None

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link is not None:
                linked.append(text)

    for m in iter(lambda: TAG.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None or m[4] == "":
            continue
        tag, ends = m[2].lower(), m[1] == "/"
        if not ends and tag not in IN_HEAD and places and places[-1].tag == "head":
            leave(len(places) - 1)
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = None if ends or "href" not in attributes(m[3]) else len(places)
            linked.append(" ")
        elif tag in RAW and not ends:
            shut = ENDS[tag].search(page, at)
            at = shut.end() if shut else len(page)
        elif tag in APART and not ends:
            if tag not in ends_of:
                ends_of[tag] = closed(tag, page)
            at = ends_of[tag].get(at, at)
            parts.append(" ")
        elif tag in BLOCK or open_tags[tag]:
            close()
            if ends:
                if open_tags[tag]:
                    leave(next(i for i in range(len(places) - 1, -1, -1) if places[i].tag == tag))
            elif tag != "hr":
                if places and places[-1].tag == "p" and tag not in ("html", "body"):
                    leave(len(places) - 1)
                if tag in ENDED_BY:
                    open_ones, bound = (x.split() for x in ENDED_BY[tag])
                    for i in range(len(places) - 1, -1, -1) if any(open_tags[t] for t in open_ones) else ():
                        if places[i].tag in bound:
                            break
                        if places[i].tag in open_ones:
                            leave(i)
                            break
                places.append(entered(tag, m[3], places[-1] if places else outside, boxes))
                open_tags[tag] += 1
    say(page[at:])
    close()
    return out, boxes


def hints(found: list[Block], boxes: list[Box], whole: bool) -> list[int]:
    """How much each box, with those around it, speaks for furniture. A form or a name doesn't if it is around most of the page."""
    plain = sum(b.words - b.linked for b in found)
    inside = [b.words for b in boxes]
    for i in range(len(boxes) - 1, -1, -1):
        if (up := boxes[i].parent) >= 0:
            inside[up] += inside[i]
            boxes[up].titled |= boxes[i].titled
    out: list[int] = []
    for b, n in zip(boxes, inside, strict=True):
        around = b.doubtful and b.hint < 3 and (b.titled or not whole) and 2 * n >= plain
        out.append(max(0 if around else b.hint, out[b.parent] if b.parent >= 0 else 0))
    return out


def features(page: str, read: tuple[list[Block], list[Box]] | None = None) -> list[tuple]:
    """Per block: words, link density, the same before and behind, place (2: in the article, 1: on a page without one, 0: beside it),
    hint, kind of element, share of cue words."""
    found, boxes = read or blocks(page)
    free = sum(b.words - b.linked for b in found if b.box < 0)
    inside = sum(b.words - b.linked for b in found if b.in_article)
    whole = any(b.in_article for b in found) and 3 * inside >= free
    hint = hints(found, boxes, whole)
    sizes = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    out = []
    for i, b in enumerate(found):
        cues = sum(w.strip(".,:;!?()").lower() in CUES for w in b.text.split()) / b.words
        place = (2 if b.in_article else 0) if whole else 1
        out.append((*sizes[i + 1], *sizes[i], *sizes[i + 2], place, hint[b.box] if b.box >= 0 else 0, b.kind, cues))
    return out


def main_text(page: str, tree: tuple) -> str:
    read = blocks(page)
    return "\n".join(b.text for b, f in zip(read[0], features(page, read), strict=True) if judge(tree, f))


def extract(df: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text and n_chars of every page."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "html"):
            out = [main_text(t, tree) for t in texts(b, "html")]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], ["key", "url", "text"])

    src = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    out = src.mapInArrow(run, "key long, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of all pages."""
    return extract(table(spark, sf_dir, "pages"))

"""Main text of HTML pages by consensus host paths.

Every page is parsed once and its containers are scored by the text of their blocks that is
not link text. The best container's path, its tags and classes from the body down with digits
generalised, is the page's vote. Votes are counted by host in Spark; the paths that hold a fair
share of a host's votes win. Pages are then extracted again: of the winning paths that have a
fair part of the page's text, the one with the most votes times text is taken, and a page without
one falls back to its own vote.

Inside the container everything is kept but menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Tags, roles and hiding say so for certain;
class and id words (and forms) only suspect: a suspected element with most of the page's text
is a wrapper and is kept, unless an article stands outside it. Character references are decoded,
white space in a block becomes one space, and blocks are joined by an empty line in page order.

Nulls and odd rows: a null or empty html has an empty text; a null or odd url counts as a host
of its own name (empty); broken markup never fails (unclosed tags end with their parents, a tag
cut off at the end is dropped); repeated rows give equal texts; pages of any length are read
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.storage import write_back

#: Copies of a host's row in the join, so that a hot host's pages meet it in that many tasks.
SALTS = 16
#: A path wins with this share of its host's votes, so at most ten win.
MIN_SHARE = 0.1
#: A page without an article votes for the lowest container with this share of its text; a
#: winning path is taken with this share of what the page's own vote holds.
MOST, FAIR = 0.8, 0.1
#: A suspected element with this share of the page's text is kept, or with the second one where all
#: words of a class or id are suspicious; not if articles outside it have this part of its text.
WRAPS, WRAPS_PURE, OUTSIDE = 0.5, 0.8, 0.15

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th option img wbr".split())
CONTAINERS = frozenset("article body center div main section td".split())
DROPPED = frozenset("aside button canvas datalist dialog footer head header input menu nav noscript object select svg template".split()) | RAW
ROLES = frozenset("alert banner complementary contentinfo dialog navigation search".split())
UNWANTED = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
OF_READERS = frozenset("comment comments disqus".split())
#: Start tags that end an open element of these names, looked for up to the second set.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article body div dl main ol section table ul".split())
#: Names of a state of the page or of what it has, not of what an element is.
STATE = re.compile(r"(?:has|no|not|with|without|is|js|hide|show)[-_].*|.*[-_](?:enabled|disabled|open|opened|closed|collapsed|expanded|active|inactive|on|off|visible|hidden)", re.I)
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


@dataclass
class Node:
    tag: str
    path: str
    container: str  # path of the nearest container, itself included
    parent: str  # path of the container above that
    dropped: bool
    link: bool
    suspects: tuple[int, ...]  # suspected elements around, itself included
    article: bool  # in an article or main element


@dataclass
class Block:
    """Text between two block borders; ``path`` is its innermost element's."""

    path: str
    container: str
    parent: str
    pieces: list[tuple[str, Node]] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html_lib.unescape("".join(t for t, _ in self.pieces)).split())


@dataclass
class Suspect:
    """What is known of an element whose words (or tag) say that it isn't the article."""

    pure: bool  # every word of a class or the id says so
    readers: bool  # by the words of reader comments
    landmark: bool = False  # holds a main element or a first heading


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}


def _dropped(tag: str, a: dict[str, str]) -> bool:
    """Whether tag, role or style say for certain that this is not the article."""
    if tag in ("html", "body"):
        return False
    if tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    return tag != "main" and "display:none" in a.get("style", "").replace(" ", "").lower()


def _suspect(tag: str, a: dict[str, str]) -> Suspect | None:
    """Whether class or id, or a form, suggest it; articles go by reader words only."""
    if tag == "form":
        return Suspect(False, False)
    if tag in ("html", "body", "main"):
        return None
    names = [{w.lower() for w in CAMEL.findall(x)} for x in f"{a.get('class', '')} {a.get('id', '')}".split() if not STATE.fullmatch(x)]
    words = set().union(*names) if names else set()
    if words == {"header"} or {"site", "header"} <= words or {"page", "header"} <= words:
        return Suspect(True, False)
    unwanted = OF_READERS if tag == "article" else UNWANTED
    if not words & unwanted:
        return None
    return Suspect(any(x and x <= unwanted for x in names), bool(words & OF_READERS))


def parse(page: str) -> list[Block]:
    """Blocks of text of a page in order, without dropped elements."""
    root = Node("", "", "", "", False, False, (), False)
    stack, blocks, open_block = [root], [], None
    suspects: list[Suspect] = []
    at, size = 0, len(page)

    def say(text: str, node: Node) -> None:
        nonlocal open_block
        if open_block is None:
            if not text or text.isspace():
                return
            open_block = Block(node.path, node.container, node.parent)
            blocks.append(open_block)
        open_block.pieces.append((text, node))
        if node.link:
            open_block.linked += len(text)

    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        node = stack[-1]
        if end > at and not node.dropped:
            say(page[at:end], node)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS and not node.dropped:
            open_block = None
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    # What stands after a dropped element is a block of its own.
                    if stack[k].dropped and not stack[k - 1].dropped and tag in BLOCKS:
                        open_block = None
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE and tag not in ("html", "form", "nav", "header", "footer", "aside", "blockquote"):
                    break
            continue
        if tag in SPACES and not node.dropped and open_block is not None:
            open_block.pieces.append((" ", node))
        if tag in VOID:
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        for name in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = stack[-1]
        raw = m[3] if m[2] else m[6]
        a = _attributes(raw) if raw and raw != "/" else {}
        dropped = node.dropped or _dropped(tag, a)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else size
            stack.append(Node(tag, node.path, node.container, node.parent, True, False, (), False))
            continue
        around = node.suspects
        if not dropped:
            if tag in ("main", "h1"):
                for k in around:
                    suspects[k].landmark = True
            if (found := _suspect(tag, a)) is not None:
                around = (*around, len(suspects))
                suspects.append(found)
        article = node.article or tag in ("article", "main")
        if tag in CONTAINERS:
            classes = ".".join(sorted({DIGITS.sub("#", c) for c in a.get("class", "").split()}))
            path = f"{node.path}/{tag}" + (f".{classes}" if classes else "")
            stack.append(Node(tag, path, path, node.container, dropped, node.link, around, article))
        else:
            stack.append(Node(tag, node.path, node.container, node.parent, dropped, node.link or tag == "a", around, article))
    return _without_suspects(blocks, suspects) if suspects else blocks


def _without_suspects(blocks: list[Block], suspects: list[Suspect]) -> list[Block]:
    """The blocks without the text of suspected elements that turn out to be no wrappers of the article."""
    held, in_articles, total, articles = [0] * len(suspects), [0] * len(suspects), 0, 0
    for b in blocks:
        for text, node in b.pieces:
            n = -len(text) if node.link else len(text)
            total += n
            articles += n * node.article
            for k in node.suspects:
                held[k] += n
                in_articles[k] += n * node.article
    out = set()
    for k, s in enumerate(suspects):
        elsewhere = articles - in_articles[k] >= OUTSIDE * max(1, held[k])
        most = held[k] >= (WRAPS_PURE if s.pure else WRAPS) * total and held[k] > 0
        if elsewhere or not most or s.readers and not s.landmark:
            out.add(k)
    if not out:
        return blocks
    found = _kept(blocks, out)
    # Where nothing is left, what was suspected is all there is.
    return found if found else _kept(blocks, {k for k in out if suspects[k].pure or suspects[k].readers}) or blocks


def _kept(blocks: list[Block], out: set[int]) -> list[Block]:
    found = []
    for b in blocks:
        pieces = [(t, n) for t, n in b.pieces if out.isdisjoint(n.suspects)]
        if any(not t.isspace() for t, _ in pieces):
            found.append(Block(b.path, b.container, b.parent, pieces, sum(len(t) for t, n in pieces if n.link)))
    return found


def _worth(b: Block) -> int:
    return max(0, len(b.text()) - 2 * b.linked)


def _under(container: str, path: str) -> bool:
    return container == path or container.startswith(f"{path}/")


def vote(blocks: Iterable[Block]) -> str | None:
    """The article that holds the best container, or the lowest container with most of the page's kept text.

    Without an article the best container may be one of several parts of the main text, so its
    ancestors are gone through until one holds MOST of what the page has.
    """
    score: Counter[str] = Counter()
    held: Counter[str] = Counter()
    for b in blocks:
        worth = _worth(b)
        score[b.container] += 2 * worth
        score[b.parent] += worth
        held[b.container] += worth
    best = min((p for p, s in score.items() if s > 0 and p), key=lambda p: (-score[p], p), default=None)
    if best is None:
        return next((b.container for b in blocks if b.container), None)
    steps = best.split("/")
    for k, step in enumerate(steps):
        if step.split(".")[0] == "article":
            return "/".join(steps[: k + 1])
    total = sum(held.values())
    for k in range(len(steps), 1, -1):
        path = "/".join(steps[:k])
        if sum(n for p, n in held.items() if _under(p, path)) >= MOST * total:
            return path
    return best


def extract(blocks: list[Block], winners: Iterable[tuple[str, int]]) -> str:
    """Text under the winning path (path, votes) with the most votes times text, or under the page's own vote.

    Paths with less than a fair part of what the own vote holds are not taken.
    """
    own = vote(blocks)
    worth = [(b.container, _worth(b)) for b in blocks] if own is not None else []
    least = FAIR * sum(n for c, n in worth if _under(c, own)) if own is not None else 0
    held = [(n * votes, -k, path) for k, (path, votes) in enumerate(winners) if (n := sum(x for c, x in worth if _under(c, path))) and (n >= least or path == own)]
    for path in ([max(held)[2]] if held else []) + [own]:
        if path is None:
            break
        inside = [t for b in blocks if _under(b.container, path) and (t := b.text())]
        if inside:
            return "\n\n".join(inside)
    return "\n\n".join(t for b in blocks if (t := b.text()))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def count_votes(pages: DataFrame) -> DataFrame:
    """(host, html) -> host, path, n. Each batch of pages sends one row for each host and path."""

    def run(stream):
        for batch in stream:
            found: Counter[tuple[str, str]] = Counter()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page and (path := vote(parse(page))) is not None:
                    found[host, path] += 1
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["host", "path", "n"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """host, paths: the winners (n, path) by falling votes. Rare paths are left out before paths are gathered."""
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"))
    strong = votes.join(totals, "host").where(F.col("n") >= MIN_SHARE * F.col("total"))  # at most 1 / MIN_SHARE a host
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return strong.groupBy("host").agg(F.transform(listed, lambda x: F.struct((-x["n"]).alias("n"), x["path"].alias("path"))).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # Written first: its size is then known when the join is planned.
    winners = write_back(winning_paths(count_votes(rows)), "host-paths")
    salted = winners.select(F.col("host").alias("w_host"), "paths", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("w_salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, F.expr("host = w_host AND salt = w_salt"), "left")

    def run(stream):
        for batch in stream:
            ids, urls, htmls, paths = (batch.column(k) for k in range(4))
            texts = [extract(parse(page), [(x["path"], x["n"]) for x in won or ()]) if page else "" for page, won in zip(htmls.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")

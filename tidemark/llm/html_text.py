"""Main text of web pages: parts that a site repeats, and parts that are no article, go."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, stored, table

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style title head nav footer aside form button input select option textarea noscript template iframe object"
    " svg canvas audio video dialog menu xmp noembed noframes map".split()
)
BLOCKS = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address hr details summary hgroup fieldset center nav aside footer form".split()
)
#: Opening one of the first closes open ones of the second.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"},
} | {t: {"p"} for t in "h1 h2 h3 h4 h5 h6 div ul ol dl table blockquote pre section article header footer nav aside form hr figure main".split()}
#: An implied end stops at these.
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Words of a class, id or role that mark menus, adverts, notices and the like, and words that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar side footer foot masthead comment comments commentlist respond disqus cookie cookies consent gdpr notice"
    " notices alert alerts popup modal overlay newsletter subscribe signup login search share sharing social related recommended"
    " widget pagination pager complementary contentinfo dialog hidden".split()
)
BESIDE = frozenset(
    "box bar container wrapper wrap inner outer content block area section list item items links link buttons button form header"
    " top bottom left right main site page primary secondary global posts post articles stories slot unit zone thread media icons"
    " open toggle policy text title".split()
)
#: Inside an article only these classes, ids and roles, each as a whole, mark what is no part of it.
INSIDE = frozenset(
    "ad ads ad-box ad-slot ad-unit ad-container advert adverts advertisement sponsored comments comment-list commentlist comment-form"
    " disqus_thread share-buttons social-share newsletter-signup related-posts related-articles cookie-notice cookie-banner"
    " complementary contentinfo navigation search dialog".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


@dataclass
class Node:
    """An element with its children, which are elements and texts."""

    tag: str
    marks: str = ""
    children: list[Node | str] = field(default_factory=list)
    digest: int = 0


def parse(page: str) -> Node:
    """The element tree of a page, of any depth; ends that are left out are implied, stray ends are ignored."""
    root = Node("#root")
    open_ = [root]
    held: Counter[str] = Counter()
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            open_[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            open_[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not held[tag]:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    _close(open_, held, k)
                    break
                if open_[k].tag in ("article", "body") and tag not in ("html", "body"):
                    break
            continue
        _close_implied(open_, held, tag)
        node = Node(tag, " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(m[3])) if m[3] else "")
        open_[-1].children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        open_.append(node)
        held[tag] += 1
    return root


def _close(open_: list[Node], held: Counter[str], k: int) -> None:
    for node in open_[k:]:
        held[node.tag] -= 1
    del open_[k:]


def _close_implied(open_: list[Node], held: Counter[str], tag: str) -> None:
    closed = CLOSES.get(tag)
    if not closed or not any(held[t] for t in closed):
        return
    fence = FENCES.get(tag, {"div", "li", "td", "th", "article", "section", "blockquote", "body"} if closed == {"p"} else set())
    low = None
    for k in range(len(open_) - 1, 0, -1):
        if open_[k].tag in fence:
            break
        if open_[k].tag in closed:
            low = k
    if low is not None:
        _close(open_, held, low)


def digests(root: Node) -> list[tuple[int, int, bool, bool]]:
    """(digest, characters, whether it lies in an article or main element, whether all its text is link text) of `root` and all below.

    Sets each element's digest, which covers the tag, its class, id and role, and, with white space normalised,
    all that is inside.
    """
    found: list[tuple[int, int, bool, bool]] = []
    # Per open element: itself, its children yet to come, what its digest covers, characters, those of links, in article.
    stack = [[root, iter(root.children), [root.tag, root.marks], 0, 0, False]]
    while stack:
        top = stack[-1]
        for child in top[1]:
            if isinstance(child, str):
                if text := " ".join(child.split()):
                    top[2].append("t" + text)
                    top[3] += len(text)
            else:
                stack.append([child, iter(child.children), [child.tag, child.marks], 0, 0, top[5] or child.tag in ("article", "main")])
                break
        else:
            stack.pop()
            node, _, parts, size, linked, inside = top
            node.digest = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
            linked = size if node.tag == "a" else linked
            found.append((node.digest, size, inside, linked == size))
            if stack:
                stack[-1][2].append(f"e{node.digest}")
                stack[-1][3] += size
                stack[-1][4] += linked
    return found


@lru_cache(4096)
def _marked(marks: str, in_article: bool) -> bool:
    tokens = marks.lower().split()
    if in_article:
        return any(t in INSIDE for t in tokens)
    for t in tokens:
        parts = [x for x in re.split(r"[-_]+", t) if x]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts):
            return True
    return False


def is_dropped(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of the article, by its tag, or by what its class, id or role says.

    Inside an article only whole names that mean nothing else count; outside of one also names made of marking words.
    """
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    return bool(node.marks) and node.tag not in ("html", "body", "article", "main") and _marked(node.marks, in_article)


@dataclass(frozen=True)
class Templates:
    """Digests of elements that a host repeats: `anywhere` on its pages, and those that count `outside` of articles only."""

    anywhere: frozenset[int] = frozenset()
    outside: frozenset[int] = frozenset()

    def hold(self, node: Node, in_article: bool) -> bool:
        return node.digest in self.anywhere or (not in_article and node.digest in self.outside)


NONE = Templates()


def blocks(node: Node, templates: Templates = NONE, in_article: bool = False) -> Iterator[str]:
    """Texts of the blocks below `node`, in page order, without dropped and template elements."""
    run: list[str] = []

    def ended() -> Iterator[str]:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            yield text

    stack = [(iter(node.children), in_article, False)]
    while stack:
        children, inside, is_block = stack[-1]
        for child in children:
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif templates.hold(child, inside) or is_dropped(child, inside):
                if child.tag in BLOCKS:
                    yield from ended()
            else:
                if child.tag in BLOCKS:
                    yield from ended()
                stack.append((iter(child.children), inside or child.tag in ("article", "main"), child.tag in BLOCKS))
                break
        else:
            stack.pop()
            if is_block:
                yield from ended()
    yield from ended()


def _roots(node: Node) -> list[Node]:
    """The outermost articles outside of dropped parts; without one, the outermost main elements, else the page."""
    for tag in ("article", "main"):
        found: list[Node] = []
        stack = [node]
        while stack:
            one = stack.pop()
            for child in reversed(one.children):
                if isinstance(child, Node) and not is_dropped(child, False):
                    stack.append(child)
            if one.tag == tag:
                found.append(one)
                del stack[len(stack) - sum(isinstance(c, Node) and not is_dropped(c, False) for c in one.children) :]
        if found:
            return found
    return [node]


def _text_of(root: Node, templates: Templates) -> str:
    found = []
    for part in _roots(root):
        inside = part.tag in ("article", "main")
        if not templates.hold(part, inside):
            found.extend(blocks(part, templates, inside))
    return "\n\n".join(found)


def main_text(page: str, templates: Templates = NONE) -> str:
    """The article's blocks, two line feeds between them, without the host's `templates`."""
    root = parse(page)
    if templates != NONE:
        digests(root)
    return _text_of(root, templates)


@dataclass(frozen=True)
class Template:
    """What makes an element a site's template: on how many of a host's pages it recurs.

    Outside of articles it must be on `pages` pages and on `share` of them, inside of one on `pages` and
    `article_share`, as texts may quote each other. Pages of equal main text count once, so copies of an article make no
    template. Elements with fewer than `characters` characters are too small to tell, but for those
    outside of articles whose text is all link text.
    """

    pages: int = 4
    share: float = 0.01
    article_share: float = 0.25
    characters: int = 12


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _element_rows(how: Template):
    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root = parse(page or "")
                found: dict[int, bool] = {}
                for digest, size, inside, linked in digests(root):
                    if size >= how.characters or (size and linked and not inside):
                        found[digest] = found.get(digest, True) and inside
                found.pop(root.digest, None)
                content = xxhash.xxh3_64_intdigest(_text_of(root, NONE).encode("utf-8", "surrogatepass")) - (1 << 63)
                n = len(found) + 1
                yield table(
                    {
                        "host": pa.array([host] * n, pa.string()),
                        "content": pa.array([content] * n, pa.int64()),
                        "element": pa.array([None, *found], pa.int64()),
                        "inside": pa.array([False, *found.values()], pa.bool_()),
                    }
                )

    return rows


def element_counts(pages: DataFrame, how: Template = Template()) -> DataFrame:
    """(host, element, pages, rows, inside): on how many different pages of a host an element is, stored.

    The null element stands for the host itself; hosts and elements on fewer than `how.pages` pages are left out.
    Counts are made per task before they move, and every page is read once. `inside` is true for elements only
    ever met in articles.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        _element_rows(how), "host string, content long, element long, inside boolean"
    )
    each = seen.groupBy("host", "content", "element").agg(F.count("*").alias("rows"), F.min("inside").alias("inside"))
    counts = each.groupBy("host", "element").agg(
        F.count("*").alias("pages"), F.sum("rows").alias("rows"), F.min("inside").alias("inside")
    )
    return stored(counts.where((F.col("pages") >= how.pages) | F.col("element").isNull()))


def site_templates(counts: DataFrame, how: Template = Template()) -> DataFrame:
    """(host, anywhere, outside): digests of the elements that recur across many pages of a host, by `element_counts`.

    A host has at most 1 / share times the elements of a page as templates, whatever the number of its pages.
    """
    size = counts.where("element is null").select(F.col("host").alias("h"), F.col("pages").alias("all"))
    recurring = counts.where("element is not null").join(size, F.col("host") == F.col("h"))
    everywhere = F.col("pages") >= F.col("all") * how.article_share
    recurring = recurring.where(everywhere | (~F.col("inside") & (F.col("pages") >= F.col("all") * how.share)))
    listed = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("element"))))
    return recurring.groupBy("host").agg(listed(everywhere).alias("anywhere"), listed(~everywhere).alias("outside"))


#: Hosts with more than this part of all pages are split; there are no more of them than that.
HOT_HOSTS = 256
#: Digests that may be sent to every executor, some 8 MB.
SENT_DIGESTS = 1_000_000


def _with_templates(rows: DataFrame, templates: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` with the lists of their host. Few templates are sent, and pages stay where they are; more are
    joined, with pages of hot hosts spread by a salt over as many parts as their share asks for."""
    templates = stored(templates).withColumnRenamed("host", "h")
    many = templates.agg(F.sum(F.size("anywhere") + F.size("outside"))).first()[0] or 0
    if many <= SENT_DIGESTS:
        return rows.join(F.broadcast(templates), F.col("host") == F.col("h"), "left")
    sizes = counts.where("element is null")
    total = sizes.agg(F.sum("rows").alias("n")).scalar()
    parts = F.ceil(F.col("rows") * HOT_HOSTS / total).cast("int")
    # At most HOT_HOSTS rows by their definition.
    hot = sizes.where(F.col("rows") * HOT_HOSTS > total).select(F.col("host").alias("hot"), parts.alias("parts"))
    spread = rows.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))))
    copies = templates.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").select(
        "h", "anywhere", "outside", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("s")
    )
    return spread.join(copies, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")


def _text_rows(batches: Batches) -> Batches:
    for batch in batches:
        texts = []
        for page, *found in zip(*(batch.column(c).to_pylist() for c in ("html", "anywhere", "outside")), strict=True):
            texts.append(main_text(page or "", Templates(*(frozenset(x or ()) for x in found))))
        yield table(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def extract_text(pages: DataFrame, how: Template = Template()) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`.

    Menus, headers outside the article, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments go, and elements that the page's host repeats. White space inside a block is one
    space; blocks are joined by two line feeds. A null or empty page has the empty text; pages without
    a host are one site; repeated rows are extracted each; extra columns are ignored; depth has no limit.
    """
    counts = element_counts(pages, how)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = _with_templates(rows, site_templates(counts, how), counts).select("page_id", "url", "html", "anywhere", "outside")
    kind = dict(pages.dtypes)
    return joined.mapInArrow(_text_rows, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")

"""Main text of web pages with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids are one node of the
tree. A node that lays out its children in many ways is important by presentation, one whose texts differ
from page to page by content; both are entropies over the different pages that have the node. A branch without any
important node is template and is cut from every page of the host, inside the main element too; the fewer pages have
it, the nearer its importance is moved to that of what stays. What markup itself names as navigation, advert, form or
comments goes as well, whatever the number of pages.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

LEAST_IMPORTANCE = 0.4  # of the most important node of a branch that stays
FEW_PAGES = 4  # a branch's importance counts as that of its pages and of so many more where it is 1: entropies of few pages tell little
DAMPING = 0.9  # the share of content in a node's importance is DAMPING ** (number of its layouts' children)

# HTML's own sets of elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# an open element that a start tag ends, and what shields it
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "body", "html", "head", "li", "dt", "dd"}
SHIELDS_P = {"button", "td", "th", "table", "caption", "object", "html"}
# elements, roles and name parts that are never main text
NOISE_TAGS = set("head nav aside footer form button select datalist menu dialog svg canvas object audio video map progress meter".split()) | RAW
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = set(
    "ad ads adsense advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promotion promos cookie cookies consent gdpr notice "
    "notices newsletter subscribe subscription paywall popup modal overlay sidebar sidenav rail widget widgets related recommended recommendations comment comments commentlist "
    "disqus respond replies discussion menu nav navbar navigation navbox breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer share sharing social "
    "login signin signup skip skiplink aside alert alerts announcement announcements search searchbox searchform".split()
)
# words that are topics as well: inside the main element they tell only together with one of PIECES, such as related-posts
TOPICS = set(
    "notice notices related recommended recommendations respond replies discussion menu nav navigation search alert alerts announcement announcements "
    "promotion promotions social share subscription login rail widget widgets consent banner banners footer toolbar skip aside overlay popup modal sponsor sponsors".split()
)
PIECES = set("list box area container wrapper wrap block posts articles links buttons bar button slot unit inner outer left right top bottom".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ANCHORED = {"div", "section", "ul", "ol"}  # whose id inside the main element names a container; those of others are anchors of the text
# a name made of these alone, such as site-header, is the head of the page
HEADER_NAMES = set("header site page top main global masthead wrapper container".split())
MAIN = {"article", "main"}
# what may be cut as a branch of its own: an item, row or heading goes with its box, a word within a sentence stays
BOXES = BLOCK - set("h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot option legend figcaption summary html body head".split())
HOLDERS = BOXES - {"p", "pre", "address"} | {"body", "html", ""}
PART, BOX, ROOT = 0, 1, 2  # of a branch: goes with its box, may be cut, main element of the page and always important

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, ""), ("text", text, "") with all ends in place.

    Missing end tags are put in as HTML implies them, end tags of nothing are skipped, comments and markup
    declarations dropped; the content of raw elements is one text.
    """
    stack: list[str] = []
    at, low = 0, page.lower()
    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            yield "text", text, ""
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in stack:
                while True:
                    gone = stack.pop()
                    yield "close", gone, ""
                    if gone == tag:
                        break
            continue
        ended, shields = ENDS.get(tag, (set(), set()))
        for targets, stops in ((ended, shields), ({"p"} if tag in ENDS_P else set(), SHIELDS_P)):
            if targets:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth] in targets:
                        while len(stack) > depth:
                            yield "close", stack.pop(), ""
                        break
                    if stack[depth] in stops:
                        break
        yield "open", tag, found[3] or ""
        if tag in VOID or (found[3] or "").rstrip().endswith("/") and tag not in BLOCK | RAW:
            yield "close", tag, ""
        elif tag in RAW:
            end = low.find(f"</{tag}", at)
            if end != at:
                yield "text", page[at:] if end < 0 else page[at:end], ""
            yield "close", tag, ""
            at = len(page) if end < 0 else end
        else:
            stack.append(tag)
    while stack:
        yield "close", stack.pop(), ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def label(tag: str, given: dict[str, str]) -> str:
    """An element as the tree knows it: tag, classes, id without digits."""
    return f"{tag}.{' '.join(sorted(given.get('class', '').split()))}#{re.sub(r'[0-9]+', '', given.get('id', ''))}"


def path_of(parent: int, own: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent} {own}") - (1 << 63)


def _named_noise(name: str, in_main: bool) -> bool:
    """Outside the main element any part of a name tells; inside, where ids are made of headings, the whole name must be a known form."""
    parts = set(re.split(r"[\s_:-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
    if in_main:
        known = parts & NOISE_NAMES
        return parts <= NOISE_NAMES | PIECES and (not known <= TOPICS or bool(known) and not parts <= NOISE_NAMES)
    return not NOISE_NAMES.isdisjoint(parts) or "header" in parts and parts <= HEADER_NAMES


def _is_noise(tag: str, given: dict[str, str], in_main: bool, kept_form: bool = False) -> bool:
    if kept_form:
        return False
    if tag in NOISE_TAGS or tag == "header" and not in_main or "hidden" in given or given.get("role", "").lower() in NOISE_ROLES:
        return True
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if tag in HEADINGS or tag in ("html", "body"):  # their names are those of the section or of the whole page
        return False
    names = given.get("class", "").split()
    if not in_main or tag in ANCHORED:
        names.append(given.get("id", ""))
    return any(_named_noise(name, in_main) for name in names)


def kept_forms(page: str) -> set[int]:
    """Which forms of the page, by their number, hold most of its text: they are its layout, not a part to fill in."""
    if "<form" not in page.lower():
        return set()
    texts: dict[int, int] = defaultdict(int)
    whole, forms = 0, 0
    stack: list[tuple[bool, bool, frozenset[int]]] = [(False, False, frozenset())]  # dropped, in main, forms around
    for kind, value, given_text in events(page):
        dropped, in_main, around = stack[-1]
        if kind == "open":
            given, form = attributes(given_text), value == "form"
            out = dropped or _is_noise(value, given, in_main, form)
            stack.append((out, in_main or not out and _is_main(value, given), around | {forms} if form else around))
            forms += form
        elif kind == "close":
            stack.pop()
        elif not dropped and (n := len(clean(value))):
            whole += n
            for form in around:
                texts[form] += n
    return {form for form, n in texts.items() if 2 * n > whole}


def _is_main(tag: str, given: dict[str, str]) -> bool:
    return tag in MAIN or given.get("role", "").lower() == "main"


def _role(tag: str, parent: str, in_main: bool, is_main: bool) -> int:
    if is_main and not in_main:
        return ROOT
    return BOX if tag in BOXES or not in_main and (tag in BLOCK or parent in HOLDERS) else PART


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def main_text(page: str, noisy: set[int]) -> str:
    """Blocks of the page outside noise and the branches ``noisy`` of its host, joined by an empty line.

    Where the page has an article or main element only those count. A page of which ``noisy`` would leave nothing is all
    the same text as others of its host; it stays as it is.
    """
    blocks: dict[bool, list[str]] = {True: [], False: []}
    layout_forms, forms = kept_forms(page), 0
    run: list[str] = []
    stack = [(0, False, False)]  # path, dropped, in main
    has_main = False

    def flush(in_main: bool) -> None:
        if run and (text := clean("".join(run))):
            blocks[in_main].append(text)
        run.clear()

    for kind, value, given_text in events(page):
        path, dropped, in_main = stack[-1]
        if kind == "text":
            if not dropped:
                run.append(value)
        elif kind == "open":
            given = attributes(given_text)
            if value in BLOCK:
                flush(in_main)
            elif value == "br":
                run.append(" ")
            own = path_of(path, label(value, given))
            out = dropped or _is_noise(value, given, in_main, value == "form" and forms in layout_forms)
            forms += value == "form"
            inside = in_main or not out and _is_main(value, given)
            has_main |= inside and not in_main
            stack.append((own, out or own in noisy, inside))
        else:
            if value in BLOCK:
                flush(in_main)
            stack.pop()
    flush(False)
    text = "\n\n".join(blocks[True] if has_main else blocks[False])
    return main_text(page, set()) if noisy and not text else text


STATS = "host string, page long, path long, above array<long>, role int, kind string, value long"


def page_nodes(host: str, page: str) -> list[tuple]:
    """(host, page, path, ancestors, role, kind, value): ``layout`` for the children of each node, ``text`` for each text in it.

    Elements with the same path in a page are one node. What markup names as noise needs no statistics. ``page`` is a
    hash of all the rest: pages that differ in noise only are the same page.
    """
    layouts, texts, above, roles = defaultdict(list), defaultdict(set), {}, {}
    layout_forms, forms = kept_forms(page), 0
    stack = [(0, "", [], False, False)]  # path, tag, children, dropped, in main
    for kind, value, given_text in events(page):
        path, tag, children, dropped, in_main = stack[-1]
        if kind == "open":
            given = attributes(given_text)
            name = label(value, given)
            own = path_of(path, name)
            out = dropped or _is_noise(value, given, in_main, value == "form" and forms in layout_forms)
            forms += value == "form"
            is_main = not out and _is_main(value, given)
            if not out:
                children.append(name)
                above[own] = [own, *above.get(path, [])]
                roles[own] = _role(value, tag, in_main, is_main)
            stack.append((own, value, [], out, in_main or is_main))
        elif kind == "close":
            if not dropped:
                layouts[path].append(" ".join(children))
            stack.pop()
        elif not dropped and path and (text := clean(value)):
            texts[path].add(xxhash.xxh3_64_intdigest(text) - (1 << 63))
    rows = [(p, above[p], roles[p], "layout", xxhash.xxh3_64_intdigest("|".join(x)) - (1 << 63)) for p, x in layouts.items() if p in above]
    rows += [(p, above[p], roles[p], "text", t) for p, found in texts.items() if p in above for t in sorted(found)]
    same = xxhash.xxh3_64_intdigest(repr([(r[0], r[3], r[4]) for r in rows])) - (1 << 63)
    return [(host, same, *r) for r in rows]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
        for at in range(0, len(pages), 500):
            rows = [r for h, p in zip(hosts[at : at + 500], pages[at : at + 500]) for r in page_nodes(h, p or "")]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def host_of(url_col: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def noisy_branches(pages: DataFrame, least: float = LEAST_IMPORTANCE, few: float = FEW_PAGES) -> DataFrame:
    """(host, noisy): the roots of the branches of each host's tree whose nodes all have low importance."""
    stats = pages.select(host_of().alias("host"), "html").mapInArrow(_stats, STATS).distinct()
    counts = stats.groupBy("host", "path", "above", "role", "kind", "value").agg(F.count("*").alias("n"))
    layout = F.col("kind") == "layout"
    nodes = counts.groupBy("host", "path", "above", "role").agg(
        F.sum(F.when(layout, F.col("n"))).alias("m"), F.sum(F.when(layout, F.col("n") * F.ln("n"))).alias("layout_ln"),
        F.count(F.when(layout, 1)).alias("layouts"), F.count(F.when(~layout, 1)).alias("texts"), F.sum(F.when(~layout, F.ln("n"))).alias("text_ln"),
    )
    ln_m = F.ln("m")
    # entropy of the layouts over the m pages, and one minus the mean entropy of the texts: a text in k pages has ln k / ln m
    presentation = F.when(F.col("m") > 1, (ln_m - F.col("layout_ln") / F.col("m")) / ln_m).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.col("text_ln") / F.col("texts") / ln_m).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.greatest(F.col("layouts"), F.lit(1)) - 1)
    importance = F.when(F.col("texts") == 0, presentation).otherwise(F.greatest(content, (1 - weight) * presentation + weight * content))
    importance = F.when(F.col("role") == ROOT, 1.0).otherwise(importance)
    spread = nodes.select("host", F.explode("above").alias("branch"), importance.alias("importance"), "m", "path", "above", "role")
    branches = spread.groupBy("host", "branch").agg(
        F.max("importance").alias("most"), *(F.max(F.when(F.col("path") == F.col("branch"), F.col(c))).alias(c) for c in ("m", "role")),
        F.max(F.when(F.col("path") == F.col("branch"), F.element_at("above", F.when(F.size("above") > 1, 2).otherwise(1)))).alias("parent"),
    )
    shrunk = (F.col("most") * F.col("m") + few) / (F.col("m") + few)
    noisy = branches.where((shrunk < least) & (F.col("role") == BOX))
    roots = noisy.join(noisy.select("host", F.col("branch").alias("parent")).withColumn("within", F.lit(True)), ["host", "parent"], "left")
    roots = roots.where(F.col("within").isNull() | (F.col("parent") == F.col("branch")))
    return roots.groupBy("host").agg(F.collect_set("branch").alias("noisy"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p or "", set(n or ())) for p, n in zip(batch.column("html").to_pylist(), batch.column("noisy").to_pylist())]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page.

    Null, empty and text-less html gives an empty text. Pages without a host in their url form one site. White space (as
    Unicode has it) inside a block becomes one space; a line break is white space. Repeated rows get the same text; pages that are equal
    but for noise count as one. Columns beside page_id, url and html are not read; an empty table gives an empty result. The
    noisy branches of a host are a few numbers; their table is stored, so that Spark sees its size and broadcasts it only if it is small.
    """
    scratch = Scratch(pages.sparkSession, "sitetree")
    noisy = scratch.keep(noisy_branches(pages))
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    return rows.join(noisy, "host", "left").select("page_id", "url", "html", "noisy").mapInArrow(_extract, "page_id long, url string, text string")

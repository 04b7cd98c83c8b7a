"""HTML extraction by union-free regular-expression inference.

Pages of one host are instances of a template. Each page's token stream becomes an element tree whose labels are tag and
class words; equal neighbours, and equal neighbouring sequences of up to three elements, fold into a repeated group. Two
such expressions are then aligned, sibling list by sibling list: what both have is aligned further, what one lacks becomes
an optional group, texts that differ become text slots. The result, the host's wrapper, has optional and repeated groups and
slots but no alternatives. Aligning one page after the other gives a wrapper for each host.

From the wrapper comes the rule for the host's main text: the smallest element that holds most of the text of slots that vary
from page to page. Among elements that hold at least half of it, the outermost ``article`` or ``main`` goes first, so that the tag
decides between containers, never against the mass of the slots. Tags and class words mark side elements,
but what holds nearly all varying text, or the article where none is outside, is not one, whatever its class. Inside it, menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments go, and so do texts that the pages with the region have in
common, as long as other text in the region varies; headings stay if what follows them varies. A text is common if its votes would still be more than three quarters with one
more page against it; a few cut or empty pages don't matter, and the rule is the same for hosts of any size. Wrappers hold one
candidate for each slot, found by majority vote in which a page with another text cancels a vote, so that between three quarters
and seven eighths of the pages the order of the votes can decide. A page without the host's region is judged by its
own tree.

On Spark: every task folds its own pages into one partial wrapper per host (hosts are flushed when there are many), partial
wrappers meet in salted groups and then by host, so a hot host costs one small tree for each task. Rules are joined back by
host; they are broadcast only when a count shows them to be few.

Defined results: null html is empty and gives an empty text, as does a page without main text; a null URL or one without
``://`` is the host ''; unclosed and stray tags are tolerated, elements
nested more than MOST_DEPTH deep only end blocks, but for the outermost marked ones, which go; a tag or comment that never ends
swallows the rest; an empty table gives an empty result; repeated rows are extracted alike; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.url_filters import url_host
from quernel.session import materialize

# Element kinds of HTML, and words that mark what is not main text.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "noscript", "template", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "title", "nav", "header", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"}
SIDE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent notice notices alert alerts gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side footer header masthead topbar comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay search widget widgets pagination pager toolbar toc skip hidden contentinfo complementary cmt cmts usernotes feedback spons".split())
PLAIN_SIDE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors spons promo promotion cookie cookies consent gdpr breadcrumb breadcrumbs share sharing newsletter subscribe subscription skip hidden pagination pager".split())
WHOLE = {"html", "body", "main"}
STATE_FIRST = {"no", "not", "non", "without", "has", "have", "with"}
STATE_LAST = {"page", "layout", "open", "opened", "closed", "on", "off", "enabled", "disabled"}
DISCUSSION = {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion"}
ANCHORS = {"article", "main", "h1"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "menu", "select"}
FIXED_SHARE, TEMPLATE_SHARE = 80, 75  # in hundredths
REGION_SHARE = 50  # in hundredths of the varying text
WHOLE_TEXT = 300
LITTLE = 20
MOST_HOSTS = 2000
MOST_DEPTH = 150
TEXTY = {"p", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt"}
TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
SPLIT = re.compile(r"[^a-z]+")


def _marked(tag: str, words) -> bool:
    """Whether tag and words are those of a menu, sidebar, comment section and so on; what they hold can overrule it, see opened_paths().

    A word marks a container. Paragraphs, items and cells are text, whatever style a word like side or search gives them: only words
    that say that a text is an advert, a notice on cookies, a share link or hidden mark these; nothing but hidden and skip marks a heading."""
    if tag in NEVER or tag in WHOLE:
        return tag in NEVER
    return not (PLAIN_SIDE & {"hidden", "skip"} if tag in HEADINGS else PLAIN_SIDE if tag in TEXTY else SIDE_WORDS).isdisjoint(words)


class Element:
    __slots__ = ("tag", "words", "label", "parts")

    def __init__(self, tag: str, words: tuple):
        self.tag, self.words = tag, words
        self.label = ".".join((tag, *words))
        self.parts: list = []  # elements and raw strings, in page order

    def is_side(self) -> bool:
        return _marked(self.tag, self.words)


def tag_end(page: str, start: int) -> int:
    """Position after the tag that starts at ``start``: the first > outside quotes, or simply the first one if quotes are open."""
    at, first = start, page.find(">", start)
    if first < 0:
        return len(page)
    while True:
        close = page.find(">", at)
        if close < 0:
            return first + 1
        quotes = [(page.find(q, at, close), q) for q in "\"'"]
        opened = min((q for q in quotes if q[0] >= 0), default=None)
        if opened is None:
            return close + 1
        if page[page.rfind("=", start, opened[0]) + 1 : opened[0]].strip():  # a stray quote
            at = opened[0] + 1
            continue
        after = page.find(opened[1], opened[0] + 1)
        if after < 0:
            return first + 1
        at = after + 1


def _is_state(parts: list[str]) -> bool:
    return len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)


def words_of(attributes: str, tag: str = "") -> tuple:
    """Words of class and role, sorted, and 'hidden'. Digits and ids are left out: they tell instances apart, not kinds; of ids only the words that
    mark side elements count, and those of sections and headings, which are named after what they are about, don't.
    A name that only says how the page is laid out (no-sidebar, has-comments, search-page) is one word, so that it marks nothing."""
    found = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "role"):
            for kind in html.unescape(value).lower().strip("\"'").split():
                parts = [w for w in SPLIT.split(kind) if w]
                found.update(["-".join(parts)] if _is_state(parts) else ["modal"] if name == "role" and "dialog" in parts + [kind.removeprefix("alert")] else parts)
        elif name == "id" and tag != "section" and tag not in HEADINGS:
            parts = [w for w in SPLIT.split(value.lower()) if w]
            found.update(() if _is_state(parts) else (w for w in parts if w in SIDE_WORDS))
        elif name == "hidden":
            found.add("hidden")
    return tuple(sorted(found))


def settle(element: Element) -> None:
    """Marked inline elements amid other text are part of it (a highlighted comment in code, a styled word in a sentence), unless a word says
    plainly that they are adverts or the like."""
    for part in element.parts:
        if isinstance(part, Element):
            settle(part)
    if element.tag != "pre" and not any(isinstance(part, str) and part.strip() for part in element.parts):
        return
    parts: list = []
    for part in element.parts:
        inline = isinstance(part, Element) and part.tag not in BLOCKS and PLAIN_SIDE.isdisjoint(part.words)
        parts.extend(part.parts if inline else [part])
    element.parts = parts


def parse(page: str) -> Element:
    """The element tree of block elements; inline elements are their text, <br> is white space."""
    root = Element("#page", ())
    stack = [root]
    deeper: list[str] = []  # names of open elements below MOST_DEPTH: they only end blocks, but for one that is marked
    marked_at = -1  # where in ``deeper`` the marked one is, whose element tops the stack
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(piece)

    while True:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            settle(root)
            return root
        text(page[at : found.start()])
        name = (found[2] or "").lower()
        if not name:
            end = page.find("-->", found.end()) + 3 if found[0] == "<!--" else page.find(">", found.end()) + 1
            at = end if end > 2 or (found[0] != "<!--" and end > 0) else len(page)
            continue
        end = tag_end(page, found.end())
        attributes = page[found.end() : end - 1]
        at = end
        if found[1]:
            if name in deeper:
                cut = len(deeper) - 1 - deeper[::-1].index(name)
                del deeper[cut:]
                if 0 <= cut <= marked_at:
                    marked_at = -1
                    stack.pop()
                stack[-1].parts.append(Element("hr", ()))
            elif name in BLOCKS or any(e.tag == name for e in stack[1:]):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        del stack[depth:]
                        deeper.clear()
                        marked_at = -1
                        break
                    if stack[depth].tag in LISTS and name in CLOSES:
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                at = tag_end(page, close.end()) if close else len(page)
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                text(" " if name != "wbr" else "")
            if name == "hr":
                stack[-1].parts.append(Element("hr", ()))
            continue
        words = words_of(attributes, name) if attributes.strip() else ()
        if name not in BLOCKS:
            if words and not SIDE_WORDS.isdisjoint(words) and not attributes.rstrip().endswith("/") and len(stack) < MOST_DEPTH:
                element = Element(name, words)  # an inline element that is marked as boilerplate
                stack[-1].parts.append(element)
                stack.append(element)
            continue
        if len(stack) >= MOST_DEPTH:
            deeper.append(name)
            if marked_at < 0 and _marked(name, words):
                marked_at = len(deeper) - 1
                element = Element(name, words)
                stack[-1].parts.append(element)
                stack.append(element)
            else:
                stack[-1].parts.append(Element("hr", ()))
            continue
        closes = CLOSES.get(name, set()) | ({"p"} if name != "p" else set())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in closes:
                del stack[depth:]
                break
            if stack[depth].tag in LISTS or (stack[depth].tag in BLOCKS and stack[depth].tag not in TEXTY):
                break
        element = Element(name, words)
        stack[-1].parts.append(element)
        stack.append(element)


def blocks_of(element: Element, skip=None, path: tuple = (), inside: bool = True, opened=frozenset()) -> list[str]:
    """Texts of the blocks under an element in page order, without side elements other than those at the paths ``opened``."""
    out, run = [], []

    def flush() -> None:
        block = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if block and not (skip and (path, text_key(block)) in skip):
            out.append(block)

    for part in element.parts:
        if isinstance(part, str):
            run.append(part)
        elif part.is_side() and (*path, part.label) not in opened:
            if part.tag in BLOCKS:
                flush()
            else:
                run.append(" ")
            if part.tag == "header" and inside:
                flush()
                out.extend(b for h in part.parts if isinstance(h, Element) and h.tag in HEADINGS and not h.is_side() for b in blocks_of(h, skip, (*path, part.label, h.label), opened=opened))
        else:
            flush()
            out.extend(blocks_of(part, skip, (*path, part.label), opened=opened))
    flush()
    return out


# A wrapper node: [label, repeated, optional, pages, characters of its own text, keys of its texts by lines or None if no text
# prevails, children, votes for this text that no page with another text has cancelled]
LABEL, PLUS, OPTIONAL, PAGES, CHARS, TEXT, CHILDREN, VOTES = range(8)
NO_TEXT = ""


def text_key(block: str) -> str:
    """A block, or a 128-bit hash of it if it is long: wrappers keep every text of a template, whatever its length."""
    return block if len(block) <= WHOLE_TEXT else "\x00" + hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def own_blocks(element: Element) -> list[str]:
    """The texts between an element's child elements."""
    runs: list[list[str]] = [[]]
    for part in element.parts:
        if isinstance(part, str):
            runs[-1].append(part)
        elif part.tag in BLOCKS or not part.is_side():
            runs.append([])
        else:
            runs[-1].append(" ")  # as in blocks_of(): a marked inline element is white space
    blocks = (" ".join(html.unescape("".join(run)).split()) for run in runs)
    return [b for b in blocks if b]


def expression(element: Element) -> list:
    """The folded expression of one page's element."""
    own = own_blocks(element)
    children = fold([expression(p) for p in element.parts if isinstance(p, Element)])
    pages = 1 if element.tag != "#page" or children else 0  # an empty or broken page shows nothing of the template
    return [element.label, False, False, pages, sum(map(len, own)), "\n".join(map(text_key, own)) if pages else None, children, pages]


def fold(children: list[list]) -> list[list]:
    """Fold runs of equal elements, then of equal sequences of two and three elements, into repeated groups."""
    for period in (1, 2, 3):
        out: list[list] = []
        for node in children:
            out.append(node)
            while len(out) >= 2 * period and [n[LABEL] for n in out[-period:]] == [n[LABEL] for n in out[-2 * period : -period]]:
                late = out[-period:]
                del out[-period:]
                for i, n in enumerate(late):
                    out[i - period] = merge(out[i - period], n, same_page=True)
                    out[i - period][PLUS] = True
        children = out
    return children


def merge(a: list, b: list, same_page: bool = False) -> list:
    """Align two expressions of the same label."""
    if a[TEXT] == b[TEXT]:
        text, votes = a[TEXT], a[VOTES] if same_page else a[VOTES] + b[VOTES]
    elif same_page:
        text, votes = (None, 0) if a[TEXT] is None or b[TEXT] is None else (text_key(a[TEXT] + "\n" + b[TEXT]), a[VOTES])
    else:
        high, low = (a, b) if a[VOTES] >= b[VOTES] else (b, a)
        text, votes = high[TEXT], high[VOTES] - low[VOTES]
    return [
        a[LABEL], a[PLUS] or b[PLUS], a[OPTIONAL] or b[OPTIONAL], a[PAGES] if same_page else a[PAGES] + b[PAGES], a[CHARS] + b[CHARS],
        text if votes else None, align(a[CHILDREN], b[CHILDREN], same_page), votes,
    ]


def is_fixed(node: list, pages: int) -> bool:
    """Whether the node's text is that of (nearly) all of so many pages."""
    return node[TEXT] is not None and node[VOTES] * 100 >= FIXED_SHARE * pages


def is_template(node: list, pages: int) -> bool:
    """Whether the node's text would be that of most pages by far even if one more page had another."""
    return node[TEXT] is not None and node[VOTES] * 100 > TEMPLATE_SHARE * (pages + 1)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """best[i, j]: length of the longest common subsequence of a[i:] and b[j:], a row at a time. Along a row it changes by steps
    of one, so its row is a running maximum of what a match at each place gives."""
    numbers = {label: k for k, label in enumerate(dict.fromkeys(b))}
    columns = np.array([numbers[label] for label in b], dtype=np.int64)
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        reached = np.where(columns == numbers.get(a[i], -1), best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(reached[::-1])[::-1]
    return best


def align(a: list[list], b: list[list], same_page: bool) -> list[list]:
    """Longest common subsequence of labels: common elements are aligned, all others become optional."""
    if [x[LABEL] for x in a] == [y[LABEL] for y in b]:
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = common_lengths([x[LABEL] for x in a], [y[LABEL] for y in b])
    out, i, j = [], 0, 0

    def lacking(node: list) -> list:
        return [*node[:OPTIONAL], True, *node[OPTIONAL + 1 :]]

    while i < n and j < m:
        if a[i][LABEL] == b[j][LABEL]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            out.append(lacking(a[i]))
            i += 1
        else:
            out.append(lacking(b[j]))
            j += 1
    out += [lacking(x) for x in a[i:]] + [lacking(y) for y in b[j:]]
    return fold(out) if any(x[LABEL] == y[LABEL] for x, y in zip(out, out[1:])) else out


def _side(label: str, path: tuple = (), opened=frozenset()) -> bool:
    tag, *words = label.split(".")
    return _marked(tag, words) and path not in opened


def varying_chars(node: list, path: tuple = (), opened=frozenset()) -> int:
    if _side(node[LABEL], path, opened):
        return 0
    return _varying_inside(node, path, opened)


def _varying_inside(node: list, path: tuple, opened) -> int:
    own = node[CHARS] if node[PAGES] < 2 or not is_fixed(node, node[PAGES]) else 0
    return own + sum(varying_chars(c, (*path, c[LABEL]), opened) for c in node[CHILDREN])


def opened_paths(wrapper: list) -> frozenset:
    """Paths of elements that are marked as side elements by tag or class but hold the main text, with those around them.

    One opens if all that is outside of marked elements is little beside its varying text, or if it has an article, a main or a
    first heading, no unmarked element is an article or main, and it holds most. A discussion opens for these tags alone, so
    that a long one under a short text stays out, and so does anything in a single page, where no text is known to vary. The
    best goes first; those further in are then held against its text.
    """
    opened: frozenset = frozenset()
    marked = []

    def collect(node: list, path: tuple, around: tuple) -> None:
        for child in node[CHILDREN]:
            here, tag = (*path, child[LABEL]), child[LABEL].split(".")[0]
            side = _side(child[LABEL])
            if side and tag in NEVER and tag not in ("form", "fieldset"):
                continue
            if side:
                marked.append((here, child, (*around, here)))
            collect(child, here, (*around, here) if side else around)

    collect(wrapper, (), ())
    if not marked:
        return opened

    def anchored(node: list, path: tuple, tags, once: bool) -> bool:
        """Whether an element below, outside of further marked ones, has one of the tags and varying text."""
        for child in node[CHILDREN]:
            here = (*path, child[LABEL])
            if _side(child[LABEL], here, opened):
                continue
            if child[LABEL].split(".")[0] in tags and not (once and child[PLUS]) and varying_chars(child, here, opened):
                return True
            if anchored(child, here, tags, once):
                return True
        return False

    while True:
        clean, best = varying_chars(wrapper, (), opened), None
        named = anchored(wrapper, (), ("article", "main"), False)
        for path, node, around in marked:
            if path in opened:
                continue
            mass = _varying_inside(node, path, opened)
            words = set(node[LABEL].split("."))
            talk = not DISCUSSION.isdisjoint(w for p in around for w in p[-1].split(".")) and not all(p in opened for p in around[:-1])
            talk = talk or not DISCUSSION.isdisjoint(words)
            itself = node[LABEL].split(".")[0] == "article" and not (talk and (node[PLUS] or len(around) > 1))
            anchor = itself or anchored(node, path, ("h1", "main") if talk else ANCHORS, talk)
            if mass and (mass > LITTLE * clean and (anchor or not talk and wrapper[PAGES] > 1) or anchor and not named and mass >= clean):
                if best is None or mass > best[0]:
                    best = mass, around
        if best is None:
            return opened
        opened |= set(best[1])


def rule_of(wrapper: list) -> dict:
    """Where the main text of a host's pages is: a path of labels, and texts in it that belong to the template."""
    region: list[tuple] = []
    opened = opened_paths(wrapper)

    def outermost(node: list, path: tuple) -> None:
        for child in node[CHILDREN]:
            here = (*path, child[LABEL])
            if _side(child[LABEL], here, opened):
                continue
            words = child[LABEL].split(".")
            if words[0] in ("article", "main") or "main" in words[1:] and words[0] == "div":
                region.append((here, child))
            else:
                outermost(child, here)

    outermost(wrapper, ())
    mass = varying_chars(wrapper, (), opened)
    if sum(varying_chars(node, path, opened) for path, node in region) * 100 < REGION_SHARE * mass:
        region = []
    if not region:
        node, path = wrapper, ()
        while True:
            mass = varying_chars(node, path, opened)
            heavy = [c for c in node[CHILDREN] if varying_chars(c, (*path, c[LABEL]), opened) * 10 >= mass * 7 and mass]
            if not heavy or heavy[0][PLUS] or heavy[0][LABEL].split(".")[0] in TEXTY:
                break
            node, path = heavy[0], (*path, heavy[0][LABEL])
        region.append((path, node))
    fixed = []

    def template(node: list, path: tuple, inside: tuple, pages: int) -> None:
        if _side(node[LABEL], (*path, *inside), opened):
            return
        if node[TEXT] and not node[PLUS] and is_template(node, pages):
            fixed.extend([list(inside), key] for key in node[TEXT].split("\n"))
        for at, child in enumerate(node[CHILDREN]):
            if child[LABEL].split(".")[0] in HEADINGS and heads_varying(node[CHILDREN][at + 1 :], (*path, *inside)):
                continue
            template(child, path, (*inside, child[LABEL]), pages)

    def heads_varying(following: list[list], around: tuple) -> bool:
        """Whether what comes up to the next heading varies: then a heading that all pages have is a heading of their texts."""
        for node in following:
            if node[LABEL].split(".")[0] in HEADINGS:
                return False
            if varying_chars(node, (*around, node[LABEL]), opened):
                return True
        return False

    for path, node in region:
        if varying_chars(node, path, opened):
            template(node, path, (), node[PAGES])
    paths = []
    for path, _ in region:
        if list(path) not in paths:
            paths.append(list(path))
    inner = [[list(p[len(path) :]) for p in sorted(opened) if len(p) > len(path) and list(p[: len(path)]) == path] for path in paths]
    return {"paths": paths, "fixed": fixed, "opened": inner}


def regions(root: Element, rule: dict) -> list[tuple]:
    """Elements of a page that stand at one of the rule's paths, in page order, with the paths that are open in each."""
    wanted = {tuple(p): frozenset(map(tuple, o)) for p, o in zip(rule["paths"], rule["opened"])}
    if () in wanted:
        return [(root, wanted[()])]
    out = []

    def visit(element: Element, path: tuple) -> None:
        for part in element.parts:
            if isinstance(part, Element):
                here = (*path, part.label)
                if here in wanted:
                    out.append((part, wanted[here]))
                elif any(w[: len(here)] == here for w in wanted):
                    visit(part, here)

    visit(root, ())
    return out


def extract(page: str, rule: dict | None) -> str:
    """The main text of one page by its host's rule; by its own structure if it lacks the host's region."""
    root = parse(page)
    found = regions(root, rule) if rule else []
    skip = {(tuple(p), t) for p, t in rule["fixed"]} if rule and found else None
    if not found or (not any(blocks_of(r, opened=o) for r, o in found) and len(root.parts)):
        found, skip = regions(root, rule_of(expression(root))), None
    return "\n".join(b for r, o in found for b in blocks_of(r, skip, opened=o))


def _infer_batches(batches):
    hosts: dict[str, list] = {}

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(w) for w in hosts.values()], pa.string())], ["host", "wrapper"])
        hosts.clear()
        return rows

    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1)):
            host, new = host.as_py(), expression(parse(page.as_py() or ""))
            hosts[host] = merge(hosts[host], new) if host in hosts else new
            if len(hosts) >= MOST_HOSTS:
                yield flush()
    yield flush()


def _merge_batches(final: bool):
    """Merge wrappers of rows (host, salt, wrapper) that come sorted by host; with ``final`` give the host's rule instead."""

    def run(batches):
        host, held = None, None

        def done():
            value = json.dumps(rule_of(held) if final else held)
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([value], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for name, wrapper in zip(batch.column(0), batch.column(1)):
                name, wrapper = name.as_py(), json.loads(wrapper.as_py())
                if held is not None and name == host:
                    held = merge(held, wrapper)
                else:
                    if held is not None:
                        yield done()
                    host, held = name, wrapper
        if held is not None:
            yield done()

    return run


def infer_rules(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(host, rule) for each host of ``pages`` (host, html)."""
    partial = pages.select("host", "html").mapInArrow(_infer_batches, "host string, wrapper string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = salted.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(_merge_batches(False), "host string, wrapper string")
    merged = some.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_batches(True), "host string, wrapper string")
    return merged.withColumnRenamed("wrapper", "rule")


def _extract_batches(batches):
    rules: dict[str, dict] = {}
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            texts = []
            for page, rule in zip(part.column(2), part.column(3)):
                rule = rule.as_py()
                if rule is not None and rule not in rules:
                    if len(rules) > MOST_HOSTS:
                        rules.clear()
                    rules[rule] = json.loads(rule)
                texts.append(extract(page.as_py() or "", rules.get(rule)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


FEW_RULES = 20_000


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and main text of every row of ``pages``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host"))
    rules = materialize(infer_rules(rows), "rules")
    few = rules.count() <= FEW_RULES and (rules.agg(F.sum(F.length("rule"))).first()[0] or 0) <= 16_000_000
    joined = rows.join(F.broadcast(rules) if few else rules, "host", "left")
    return joined.select("page_id", "url", "html", "rule").mapInArrow(_extract_batches, "page_id long, url string, text string")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# The pages of the driver's table share one template, for which SQL can say what the main text is.
ORACLE = r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS blocks FROM pages),
t AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FOR x IN blocks] AS blocks FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text FROM t)
"""

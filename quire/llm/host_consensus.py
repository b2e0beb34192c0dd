"""HTML extraction: consensus host paths.

Each page's containers are scored by the text of their blocks, and the page votes for the
generalised tag-class path of its best one. Votes are counted for each host in Spark. Pages are
then extracted again by the winning paths of their host, so that one odd page follows its template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_ids, small, written

#: Share of a host's votes from which a path wins; so a host has at most five.
SHARE = 0.2

ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may end a tag or hide its end: a bracket, or the quote of a value.
TAG_MARK = re.compile(r""">|=\s*(["'])""")
# fixed values: kinds of elements in HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = set("nav header footer aside dialog menu button select option datalist fieldset svg canvas object audio video head".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names of page furniture, and of main text.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot sidebar side aside widget widgets related recommended share sharing social comment comments disqus reply replies newsletter subscribe subscription signup login popup modal overlay form search pagination pager skip hidden".split()
)
#: Names of reader comments, which may stand in an article element of their own.
COMMENTS = set("comment comments disqus reply replies".split())
#: Words before one of FURNITURE in a name that tells of a state of the page: has-sidebar, no-comments.
STATES = set("has have with without no not hide show is".split())
MAIN = set("article content main post entry story body text page".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: Names that take an inline element out; others, such as "form" or "comment", are kinds of words there.
INLINE_FURNITURE = set("ad ads advert adverts advertisement sponsor sponsored promo share sharing social breadcrumb breadcrumbs pager pagination newsletter subscribe popup cookie consent".split())
#: Elements of which text belongs to what holds them.
LEAVES = set("p li h1 h2 h3 h4 h5 h6 blockquote pre td dd dt figcaption".split())
TITLES = set("h1 article main".split())
#: Elements that may stand in a head; any other one, and text, begins the body.
OF_HEAD = set("base basefont bgsound link meta noframes head".split()) | RAW
#: An element of SAME or a paragraph is not closed over one of these.
BARRIERS = set("ul ol table dl article section div body blockquote td".split())


@dataclass
class Block:
    """A block: the innermost open block element, its text, and how many of its characters stand in links."""

    node: int
    text: str
    linked: int


class Page:
    """The block elements and blocks of a page, read in one pass.

    Elements have numbers in order of their start tags, so parents come before children, and what holds
    for an element and all within it is one pass over the numbers. ``html`` and ``body`` are there
    whether the page has their tags or not.
    """

    def __init__(self, page: str):
        self.tag, self.step, self.parent, self.skip, self.doubt, self.words = ["html", "body"], ["html", "body"], [-1, 0], [False, False], [False, False], [set(), set()]
        self.blocks: list[Block] = []
        self._read(page)
        self.path: list[int] = []
        known: dict[tuple[int, str], int] = {}
        for parent, step in zip(self.parent, self.step, strict=True):
            self.path.append(known.setdefault((self.path[parent] if parent >= 0 else -1, step), len(known)))
        self._settle()

    def _add(self, tag: str, parent: int, names: dict[str, str], skipped: bool) -> int:
        classes, parts, hidden = _marks(names)
        marked = [ws for ws in parts if not STATES & set(ws[:-1]) and FURNITURE & set(ws)]
        words = {w for ws in parts for w in ws}
        furniture = any(FURNITURE.issuperset(ws) for ws in marked) and (tag not in ("main", "article") or bool(COMMENTS & words))
        self.tag.append(tag)
        self.step.append(_step(tag, classes))
        self.parent.append(parent)
        self.skip.append(skipped or tag in SKIPPED or furniture or hidden or names.get("role", "").lower() in ROLES)
        self.doubt.append((bool(marked) or tag == "form") and not furniture and tag not in ("main", "article"))
        self.words.append(words)
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        # open elements: (tag, number or -1 for an inline one, whether its text is left out); body is never closed
        stack: list[tuple[str, int, bool]] = [("body", 1, False)]
        where: dict[str, list[int]] = {"body": [0]}  # places in the stack by tag
        outer = [0]  # places of block elements
        parts: list[str] = []
        linked = links = 0

        def end_block() -> None:
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append(Block(stack[outer[-1]][1], text, linked))
                linked = 0

        def add_text(s: str) -> None:
            nonlocal linked
            if s and "head" in where and where["head"] and not s.isspace():
                close(where["head"][-1])
            if s and not stack[-1][2]:
                parts.append(s)
                linked += len(s) if links else 0

        def close(place: int) -> None:
            nonlocal links
            while len(stack) > place:
                tag, number, _ = stack.pop()
                where[tag].pop()
                if number >= 0:
                    outer.pop()
                links -= tag == "a"

        def open_(tag: str, number: int, skipped: bool) -> None:
            nonlocal links
            where.setdefault(tag, []).append(len(stack))
            if number >= 0:
                outer.append(len(stack))
            stack.append((tag, number, skipped))
            links += tag == "a"

        last = lambda tags: max((where[t][-1] for t in tags if where.get(t)), default=-1)
        for kind, tag, raw, chars in tokens(page):
            if kind == "text":
                add_text(chars)
                continue
            if tag not in INLINE:
                end_block()
            if kind == "end":
                place = last((tag,))
                if place > 0 and not (tag in INLINE and outer[-1] > place):
                    close(place)
                continue
            if last(("head",)) > 0 and tag not in OF_HEAD:
                close(last(("head",)))
            names = _names(raw) if raw.strip() else {}
            if tag in ("html", "body"):
                number = int(tag == "body")
                self.step[number] = _step(tag, _marks(names)[0])
                continue
            if tag in VOID or tag in INLINE and raw.rstrip().endswith("/"):
                continue
            closes = SAME.get(tag, set()) | ({"p"} if tag not in INLINE else set())
            place = last(closes)
            if place > last(BARRIERS - {tag} - closes):
                close(place)
            skipped = stack[-1][2]
            if tag in INLINE:
                _, parts_, hidden = _marks(names)
                plain = "pre" in where and where["pre"] or "code" in where and where["code"] or tag == "code"
                ad = not plain and any(INLINE_FURNITURE.issuperset(ws) for ws in parts_)
                open_(tag, -1, skipped or hidden or ad or names.get("role", "").lower() in ROLES)
            else:
                number = self._add(tag, stack[outer[-1]][1], names, skipped)
                open_(tag, number, self.skip[number])
        end_block()

    def _settle(self) -> None:
        """Elements that only a part of a name marks, and forms, are furniture unless they hold a title or article
        and most of the text; marked elements are none either if nothing is left without them."""
        held, titled = [0] * len(self.tag), [False] * len(self.tag)
        if any(self.doubt):
            for b in self.blocks:
                held[b.node] += len(b.text)
            for i in range(len(self.tag) - 1, 0, -1):
                if held[i]:
                    titled[i] = titled[i] or self.tag[i] in TITLES
                    held[self.parent[i]] += held[i]
                    titled[self.parent[i]] = titled[self.parent[i]] or titled[i]
            gone = [d and not (t and 2 * h > held[0]) for d, t, h in zip(self.doubt, titled, held, strict=True)]
            forms = self._under([g and tag == "form" for g, tag in zip(gone, self.tag, strict=True)])
            gone = self._under(gone)
            self.blocks = [b for b in self.blocks if not gone[b.node]] or [b for b in self.blocks if not forms[b.node]]

    def path_of(self, node: int) -> str:
        steps = []
        while node >= 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def _under(self, nodes: list[bool]) -> list[bool]:
        """Elements that are, or stand within, the marked ones."""
        for i in range(1, len(nodes)):
            nodes[i] = nodes[i] or nodes[self.parent[i]]
        return nodes

    def best(self) -> int | None:
        """The element that scores best, lifted: its own blocks count whole, its children's half, less what
        stands in links."""
        scores: dict[int, float] = defaultdict(float)
        first: dict[int, int] = {}
        for b in self.blocks:
            value = max(0, len(b.text) - 2 * b.linked) + 10 * (b.text.count(",") + b.text.count("."))
            node, weight = b.node if self.tag[b.node] not in LEAVES else self.parent[b.node], 1.0
            while node >= 0 and weight >= 0.1:
                bonus = 1.5 if self.tag[node] in ("article", "main") else 1.25 if self.words[node] & MAIN else 1.0
                scores[self.path[node]] += value * weight * bonus
                first.setdefault(self.path[node], node)
                node, weight = self.parent[node], weight / 2
        if not scores:
            return None
        most = max(scores.values())
        return self._lifted(max((first[p] for p, score in scores.items() if score == most), key=self.path_of))

    def _lifted(self, node: int) -> int:
        """The outermost article that holds ``node``, or the main around it if that adds no block of links; else its
        main; else the outermost ancestor that adds no block of links."""
        chain = [node]
        while self.parent[chain[-1]] >= 0:
            chain.append(self.parent[chain[-1]])
        holder = {tag: next((n for n in reversed(chain) if self.tag[n] == tag), None) for tag in ("article", "main")}
        within = self._under([p == self.path[node if holder["article"] is None else holder["article"]] for p in self.path])
        if holder["article"] is not None:
            outside = holder["main"]
            around = None if outside is None else self._under([n == outside for n in range(len(self.tag))])
            added = [b for b in self.blocks if around and around[b.node] and not within[b.node]]
            return outside if added and chain.index(outside) > chain.index(holder["article"]) and not any(2 * b.linked > len(b.text) for b in added) else holder["article"]
        if holder["main"] is not None:
            return holder["main"]
        # blocks within an element stand in a row: each step outwards looks at those that it adds
        level = {n: k for k, n in enumerate(chain)}
        depth = [0] * len(self.tag)  # the innermost element of the chain that holds each element
        for i in range(len(self.tag)):
            depth[i] = level[i] if i in level else depth[self.parent[i]]
        adds: dict[int, list[Block]] = defaultdict(list)
        for b in self.blocks:
            if not within[b.node]:
                adds[depth[b.node]].append(b)
        for k in range(1, len(chain)):
            if self.tag[chain[k]] == "html" or any(2 * b.linked > len(b.text) for b in adds[k]):
                break
            if adds[k]:
                node = chain[k]
        return node

    def text_under(self, path: str) -> list[str]:
        """The texts of the blocks under the elements of ``path``."""
        steps = path.split(">")
        met = [0] * len(self.tag)  # steps of the path that lead to an element, if all above it are on the path
        depth = [0] * len(self.tag)
        for i in range(len(self.tag)):
            up = self.parent[i]
            depth[i] = depth[up] + 1 if up >= 0 else 1
            if (up < 0 or met[up] == depth[up]) and depth[i] <= len(steps) and self.step[i] == steps[depth[i] - 1]:
                met[i] = depth[i]
        within = self._under([m == len(steps) for m in met])
        return [b.text for b in self.blocks if within[b.node]]


def _names(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _marks(names: dict[str, str]) -> tuple[list[str], list[list[str]], bool]:
    """Class names, the words of each class and id name, and whether an element is hidden."""
    if not names:
        return [], [], False
    classes = names.get("class", "").lower().split()
    parts = [[w for w in re.split(r"[^a-z]+", n) if w] for n in [*classes, *names.get("id", "").lower().split()]]
    hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", names.get("style", ""), re.I))
    return classes, [ws for ws in parts if ws], hidden


def _step(tag: str, classes: list[str]) -> str:
    """The generalised step of a path: numbers in class names are alike."""
    return tag + "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c).replace(">", "#") for c in classes}))


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, attributes, characters): texts, and start and end tags without comments and raw text.

    Each character is looked at a bounded number of times: a bracket that no other ends is text, as is all
    behind it, and once a quote is not closed, tags end at the next bracket.
    """
    at, n, quoted = 0, len(page), True
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            if begin > at:
                yield "text", "", "", page[at:begin]
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        slash = page.startswith("/", begin + 1)
        name = TAG_NAME.match(page, begin + 1 + slash)
        if not name and not page.startswith(("!", "?"), begin + 1):
            yield "text", "", "", page[at : begin + 1]
            at = begin + 1
            continue
        end = page.find(">", begin)
        if end < 0:
            break
        if name and quoted:
            look = name.end()
            while True:
                mark = TAG_MARK.search(page, look)
                if not mark or mark[0] == ">":
                    end = mark.start() if mark else -1
                    break
                closing = page.find(mark[1], mark.end())
                if closing < 0:
                    end = -1
                    break
                look = closing + 1
            if end < 0:
                quoted, end = False, page.find(">", begin)
        if begin > at:
            yield "text", "", "", page[at:begin]
        at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        yield ("end" if slash else "start"), tag, page[name.end() : end], ""
        if tag in RAW and not slash:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            yield "end", tag, "", ""
    if at < n:
        yield "text", "", "", page[at:]


def best_path(page: str) -> str | None:
    """The path of the page's best container, or None for a page without text."""
    parsed = Page(page)
    node = parsed.best()
    return None if node is None else parsed.path_of(node)


def extract(page: str, paths: list[str]) -> str:
    """The blocks under the first of ``paths`` that the page has, else under its own best one."""
    parsed = Page(page)
    for path in paths:
        if texts := parsed.text_under(path):
            return "\n".join(texts)
    node = parsed.best()
    return "" if node is None else "\n".join(parsed.text_under(parsed.path_of(node)))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        votes = Counter((h, best_path(p)) for h, p in zip(batch["host"], batch["html"], strict=True) if isinstance(p, str))
        yield pd.DataFrame([(h, p, n) for (h, p), n in votes.items() if p], columns=["host", "path", "n"])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [extract(p, [] if w is None else list(w)) if isinstance(p, str) else "" for p, w in zip(batch["html"], batch["paths"], strict=True)]
        yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first; at most 1 / SHARE of them."""
    votes = written(pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(_vote, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n")), "host-votes")
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    won = votes.join(total, "host").filter(F.col("n") >= SHARE * F.col("total"))
    return won.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html).

    A null html counts as empty; a page without main text has an empty one. Pages without a host
    (null or malformed url) vote together as one host. Tied paths win in order of their names;
    repeated rows are extracted each and vote each; an empty table gives no rows; other columns are
    not looked at. Blocks are split at block elements and at <br>.
    """
    won = written(winning_paths(pages), "host-paths")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return map_ids(own.join(small(won), "host", "left").select("page_id", "url", "html", "paths"), _extract, "url string, text string, n_chars long", "page_id")

"""Main text of web pages by consensus host paths.

A page is cut into blocks of text, each inside a chain of containers. Boilerplate (menus, headers, footers, side bars, notices,
adverts, forms, comments) is known by tags, roles and class words and carries no weight; the verdict on an element is taken when the page
is read, and is lifted where it would condemn the article itself (see Page._lift). The page's vote is the lowest container that
holds all remaining text but blocks of links; where most of the text is in one article or main element, all that is in it, and the
page's title. It is named by its generalised path of tags and classes (digits become #).
Votes are counted per host in Spark, partly before the shuffle, so a host with a third of all pages costs no more than others; every page is then extracted
again from the elements on its host's winning path, and from its own vote too if these elements hold clearly less than that or not the
title (a class such as post or entry on them is trusted: then what is outside, however long, is not the article).

Defined results: a null html is empty and gives an empty text; a null url, or one without ://, belongs to the host ''; broken, unclosed
and cut-off markup is read as far as it goes; repeated rows vote and are extracted each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textops import streamed

#: Tags without content, with raw content, of blocks, of containers, of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body".split())
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
BOILER_TAGS = frozenset("nav aside footer form button select dialog menu head fieldset".split())
#: Of these the ones that are never the article, and the words that no class of a wrapper of the article has.
NEVER_TAGS = frozenset("nav select button menu head".split())
NEVER_ROLES = frozenset("navigation menu menubar".split())
LATE_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses related recommended outbrain taboola cookie cookies consent gdpr".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar widget ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond responses form search pagination pager toolbar skip outbrain taboola".split()
)
#: What marks a header as part of the article.
ARTICLE_WORDS = frozenset("article post entry story".split())

_TOKEN = re.compile(
    r"""<!---?>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?|["']""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Open:
    """An open element; block: where on the stack the block element nearest to it is, itself included."""

    __slots__ = ("block", "container", "inside", "mark", "path", "tag", "title")

    def __init__(self, tag: str, path: int, mark: int, inside: bool, container: int | None, title: bool = False, block: int = 0):
        self.tag, self.path, self.mark, self.inside, self.container, self.title, self.block = tag, path, mark, inside, container, title, block


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw) if raw and not raw.isspace() else ():
        if m[1]:
            value = m[2] or ""
            found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ('"', "'") else value)  # the first of a name counts
    return found


def _words(name: str) -> set[str]:
    return set(_WORD.findall(_CAMEL.sub(" ", name).lower()))


def _boiler(tag: str, at: dict[str, str], inside: bool) -> tuple[int, frozenset[str]] | None:
    """How surely an element is boilerplate, if it is: 0 a class or id only has such a word in it, or a form; 1 one is such a word; 2 by tag, role or hidden; 3 navigation. And the names that say so."""
    role = at.get("role", "").lower()
    if tag in NEVER_TAGS or role in NEVER_ROLES:
        return 3, frozenset()
    names = f"{at.get('class', '')} {at.get('id', '')}".split() if "class" in at or "id" in at else []
    words = {n: _words(n) for n in names}
    every = set().union(*words.values())
    named = tag not in ("body", "html", "article", "main")
    said = frozenset(n for n, w in words.items() if named and w & BOILER_WORDS)
    header = (tag == "header" or "header" in every) and not inside and not every & ARTICLE_WORDS and tag not in ("body", "html")
    if header:
        said |= {n for n, w in words.items() if "header" in w}
    soft = tag in ("form", "fieldset") or role == "form"
    hard = (tag in BOILER_TAGS or role in BOILER_ROLES) and not soft
    if hard or (header and tag == "header") or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")) or (named and every & LATE_WORDS):
        return 2, said
    if said:
        return int(any(len(words[n]) == 1 for n in said)), said
    return (0, said) if soft else None


class Page:
    """blocks: (text, weight, id of the container around it) of all text that is no boilerplate; titles: which blocks are in an h1; paths, parents, semantic (article or main): of each container.

    Paths are numbers: a path is its last step after another path, and equal paths have equal numbers, however deep they are."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.paths: list[int] = [0]
        self._steps: list[tuple[int, str]] = [(-1, "")]  # of each path: the path before its last step, and that step
        self._known: dict[tuple[int, str], int] = {}
        self._held: dict[str, list[int]] = {}  # where on the stack the open elements of each tag are
        self.parents: list[int] = [-1]
        self.semantic: list[bool] = [False]
        self.titles: set[int] = set()
        self._text: list[str] = []
        self._linked = 0
        self._para = 0
        self._pieces: list[tuple[str, int, int, int, bool, int]] = []  # text, linked, container, mark, title, paragraph
        self._marks: list[tuple[int, int, frozenset[str]]] = [(-1, 0, frozenset())]  # parent, kind, names of each element that looks like boilerplate; 0: none
        self._articles: list[tuple[int, int, bool]] = []  # container, mark, whether main
        self._read(html)
        self._settle(self._lift())

    def _flush(self, top: _Open, breaks: bool = True) -> None:
        if self._text:
            if top.mark >= 0:
                self._pieces.append(("".join(self._text), self._linked, top.container or 0, top.mark, top.title, self._para))
            self._text, self._linked = [], 0
        self._para += breaks

    def _settle(self, free: set[int]) -> None:
        """Blocks from the pieces of free marks; a paragraph goes on after an inline element that is left out."""
        last: list = ["", 0, 0, False, -1]
        for text, linked, container, mark, title, para in self._pieces:
            if mark not in free:
                continue
            if last[2] == container and last[4] == para:
                last[0], last[1], last[3] = last[0] + text, last[1] + linked, last[3] or title
            else:
                self._block(*last[:4])
                last = [text, linked, container, title, para]
        self._block(*last[:4])

    def _block(self, raw: str, linked: int, container: int, title: bool) -> None:
        if text := " ".join(raw.split()):
            if title:
                self.titles.add(len(self.blocks))
            self.blocks.append((text, max(1, len(text) - 2 * linked), container))

    def _lift(self) -> set[int]:
        """The marks that are no boilerplate, 0 among them. Lifted are, with all marks around it: the mark around the page's article or main,
        the one around most of the text where no article says better, and, if nothing else is left, the one with most of the text."""
        marks, free = self._marks, {0}
        if len(marks) == 1:
            return free
        own = [0] * len(marks)
        weigh = [max(1, len(p[0]) - 2 * p[1]) if p[0] and not p[0].isspace() else 0 for p in self._pieces]
        for p, w in zip(self._pieces, weigh, strict=True):
            own[p[3]] += w
        held = own[:]
        for m in range(len(marks) - 1, 0, -1):  # children come after their parents
            held[marks[m][0]] += held[m]
        total = held[0]
        if own[0] == total:
            return free

        kind = [0] * len(marks)  # the surest of a mark and those around it
        for m in range(1, len(marks)):
            kind[m] = max(kind[marks[m][0]], marks[m][1])

        def lift(m: int) -> None:
            while m not in free:
                free.add(m)
                m = marks[m][0]

        at_mark = {c: m for c, m, _ in self._articles}
        near = [0] * len(self.paths)  # the article or main around each container
        for c in range(1, len(near)):
            near[c] = c if c in at_mark else near[self.parents[c]]
        inside = dict.fromkeys(at_mark, 0)  # weight in each article, without boilerplate in it
        for p, w in zip(self._pieces, weigh, strict=True):
            if at_mark.get(near[p[2]]) == p[3]:
                inside[near[p[2]]] += w
        for c in sorted(at_mark, reverse=True):
            if at_mark.get(around := near[self.parents[c]]) == at_mark[c]:
                inside[around] += inside[c]
        found = [(inside[c], -c, m, main) for c, m, main in self._articles if inside[c]]
        if found:
            weight, _, m, main = max(found)
            clear, half = [x for x in found if x[2] == 0], 2 * weight >= total
            alone = all(x[3] for x in clear)  # no article is outside, a main may be
            if (half or alone, alone, not clear and (main or half))[kind[m]]:
                lift(m)
        sure, names = any(x[2] in free for x in found), set()
        for m in range(1, len(marks)):
            if m not in free and kind[m] <= (0 if sure else 1) and held[m] >= (0.8 if sure else 0.5) * total:
                lift(m)
                names |= marks[m][2]
        for m in range(1, len(marks)):  # a name that wraps the article says nothing about other elements either
            if marks[m][1] == 0 and marks[m][2] & names and marks[m][0] in free:
                free.add(m)
        if not any(own[m] for m in free):
            lift(max((m for m in range(1, len(marks)) if own[m]), key=lambda m: (-kind[m], own[m], -m)))
        return free

    def _read(self, html: str) -> None:
        stack = [_Open("", 0, 0, False, 0)]
        at, size, links = 0, len(html), 0
        while at < size:
            m = _TOKEN.search(html, at)
            end = m.start() if m else size
            if end > at and stack[-1].mark >= 0:
                text = html[at:end]
                text = unescape(text) if "&" in text else text
                self._text.append(text)
                if links:
                    self._linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA[") and stack[-1].mark >= 0:
                    self._text.append(m[0][9:].removesuffix("]]>"))
                continue
            closing, raw = bool(m[1] or m[4]), m[3] if m[2] else m[6] or ""
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                self._close(stack, tag)
                continue
            if tag in RAW:
                if not raw.endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
                    at = stop.end() if stop else size
                continue
            if tag in VOID:
                if tag == "br":
                    if stack[-1].mark >= 0:
                        self._text.append(" ")
                elif tag == "hr":
                    self._flush(stack[-1])
                continue
            if tag in BLOCK:
                self._flush(stack[-1])
                self._imply(stack, tag)
            if raw.endswith("/") and tag not in BLOCK:
                continue
            top = stack[-1]
            names = _attributes(raw)
            path, container = top.path, top.container
            if tag in BLOCK and tag not in ("p", "html"):
                classes = ".".join(re.sub(r"\d+", "#", c) for c in names.get("class", "").split())
                path = self._step(path, f"{tag}.{classes}".replace(">", "") if classes else tag)
            if tag in CONTAINER:
                container = len(self.paths)
                self.paths.append(path)
                self.parents.append(top.container or 0)
                self.semantic.append(tag in ("article", "main"))
            inside = top.inside or tag in ("article", "main")
            mark = top.mark
            if mark >= 0 and (verdict := _boiler(tag, names, inside)):
                self._flush(top, False)
                mark = -1 if verdict[0] == 3 else len(self._marks)
                if mark > 0:
                    self._marks.append((top.mark, *verdict))
            if mark >= 0 and (tag == "main" or (tag == "article" and not _words(f"{names.get('class', '')} {names.get('id', '')}") & BOILER_WORDS)):
                self._articles.append((container, mark, tag == "main"))
            self._held.setdefault(tag, []).append(len(stack))
            stack.append(_Open(tag, path, mark, inside, container, top.title or tag == "h1", len(stack) if tag in BLOCK else top.block))
        self._flush(stack[-1])

    def _step(self, path: int, step: str) -> int:
        found = self._known.setdefault((path, step), len(self._steps))
        if found == len(self._steps):
            self._steps.append((path, step))
        return found

    def _drop(self, stack: list[_Open], k: int) -> None:
        while len(stack) > k:
            self._held[stack.pop().tag].pop()

    def _imply(self, stack: list[_Open], tag: str) -> None:
        """A block tag ends the paragraph or item around it, whatever inline elements are open in there."""
        k = stack[-1].block
        if k and tag in CLOSES.get(stack[k].tag, ()):
            self._drop(stack, k)

    def _close(self, stack: list[_Open], tag: str) -> None:
        if tag in BLOCK:
            self._flush(stack[-1])
        held = self._held.get(tag)
        if not held or (tag not in BLOCK and held[-1] < stack[-1].block):
            return
        if stack[-1].mark != stack[held[-1] - 1].mark:
            self._flush(stack[-1], False)
        self._drop(stack, held[-1])

    def vote(self, share: float = 0.7) -> tuple[int, float]:
        """The lowest container of all blocks but blocks of links, and how much of the weight it holds. If `share` of the weight is in one article or main, only the blocks in it count, and the title."""
        weight = [0] * len(self.paths)
        for _, w, c in self.blocks:
            weight[c] += w
        for c in range(len(weight) - 1, 0, -1):  # children come after their parents
            weight[self.parents[c]] += weight[c]
        total, best = weight[0], 0
        for c in range(1, len(weight)):
            if total and weight[c] >= share * total and self.parents[c] == best:
                best = c
        scope, at = 0, best
        while at > 0:
            scope, at = at if self.semantic[at] else scope, self.parents[at]
        inside = self._within({scope})
        needed = {c for k, (_, _, c) in enumerate(self.blocks) if inside[c] and self._counts(k)}
        titles = {self.blocks[k][2] for k in self.titles}
        if not any(inside[c] for c in titles):
            needed |= titles
        best = self._common(needed) if needed else best
        return best, weight[best] / total if total else 0.0

    def _counts(self, k: int) -> bool:
        """Whether a block is more than links."""
        text, weight, _ = self.blocks[k]
        return weight > 1 or len(text) == 1 or k in self.titles

    def _common(self, containers: set[int]) -> int:
        """The lowest container around all of them."""
        best, *rest = containers
        for c in rest:
            while c != best:
                best, c = (self.parents[best], c) if best > c else (best, self.parents[c])
        return best

    def name(self, container: int) -> str:
        steps, at = [], self.paths[container]
        while at:
            at, step = self._steps[at]
            steps.append(step)
        return ">".join(reversed(steps))

    def _path(self, name: str) -> int | None:
        """The number of the path of that name, if the page has it."""
        at: int | None = 0
        for step in name.split(">") if name else ():
            at = self._known.get((at, step))
            if at is None:
                return None
        return at

    def text(self, path: str | None, enough: float = 0.9) -> str:
        """The blocks inside the elements on the path; also those of the page's own vote if the former hold less than `enough` of its weight, or not its title, and are not named an article by their class."""
        wanted = self._path(path) if path is not None else None
        chosen = {c for c in range(1, len(self.paths)) if self.paths[c] == wanted}
        inside = self._within(chosen)
        kept = {k for k, (_, _, c) in enumerate(self.blocks) if inside[c]}
        if not kept or not set(_WORD.findall(path.rpartition(">")[2].lower())) & ARTICLE_WORDS - {"article"}:
            best = self.vote()[0]
            inside = self._within({c for c in range(len(self.paths)) if c == best or (best and self.paths[c] == self.paths[best])})
            own = {k for k, (_, _, c) in enumerate(self.blocks) if inside[c]}
            heavy = lambda of: sum(self.blocks[k][1] for k in of if self._counts(k))
            if not kept or heavy(kept) < enough * heavy(own) or (own & self.titles and not kept & self.titles):
                kept |= own
        return "\n\n".join(t for k, (t, _, _) in enumerate(self.blocks) if k in kept)

    def _within(self, chosen: set[int]) -> list[bool]:
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):
            inside[c] = c in chosen or (c > 0 and inside[self.parents[c]])
        return inside


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            paths, scores = [], []
            for html in part.column(1).to_pylist():
                page = Page(html or "")
                best, score = page.vote()
                paths.append(page.name(best) if page.blocks and best else None)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the winning path of each host (most votes, then score, then by name)."""
    votes = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(streamed(_votes), "host string, path string, score double")
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    best = counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"), F.col("best.votes").alias("votes"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            texts = [Page(html or "").text(path) for html, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(3)], ["page_id", "url", "text", "n_chars", "path"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""
    from tidelog.session import settle

    winners = settle(host_paths(pages, url_col, html_col), "html-host-paths")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    if winners.count() <= most:
        joined = rows.join(F.broadcast(winners.select("host", "path")), "host", "left")
    else:  # too many hosts: deal each over salts, for one host may have a third of the pages
        salts = 64
        spread = winners.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(streamed(_texts), "page_id long, url string, text string, n_chars long, path string")

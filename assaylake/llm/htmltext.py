"""Main text of web pages by consensus host paths.

Each page is read once into its containers (article, main, section, div and the like) with the text they hold outside of boilerplate. A container
scores by the characters of its own blocks, less those in links, and half of what its child containers score. The best one is widened: to the
outermost article or main around it, else to the outermost container that adds blocks of its own, headings say, or siblings that aren't small beside it. The page
votes for the path of the result, tags with all their classes from the root, with digits taken out. Votes are counted by host in Spark, ahead of the
shuffle as far as they can be. Then every page is read again and the containers on its host's winning path are its text; a page that has none,
or none with text, takes its own choice.

Boilerplate is left out by tag (nav, footer, aside, form, script, header outside of an article, ...), by role, by hidden attributes, by classes and ids that consist of known
words only ("share-bar" is boilerplate, "share-price" isn't), and, outside of articles, containers that are little but links. Words that content also uses ("search", "related") count only where nothing but layout stands beside
them: "related-posts" is boilerplate, "related-work" isn't. An element that is left out for its class but has nearly all of the page's text is read after all, unless it holds reader comments. A host's path gives way to an article of the page's own where its text is small beside that. Blocks are joined by one space, and any run of white space is one space.

A page is read in time and memory linear in its length: unclosed tags, quotes and comments and any depth of nesting included.

Defined results: null or empty html gives the empty text; a null or odd url is on the host ""; ties between paths go to the smaller path; a "<" that starts no
tag, and a tag that never ends, are text; rows that repeat vote as often and give equal texts; an empty table gives no rows; other columns stay, whatever
their names, those named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# HTML element names and words of class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg canvas object nav footer aside form button select dialog menu".split())
CONTAINERS = frozenset("html body main article section div td th center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address details summary fieldset hgroup br hr nav header footer aside form dialog menu".split())
CLOSES_P = BLOCKS - {"br"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = ("ul", "ol", "table")
MARKS = frozenset(
    "nav navbar navigation menu menubar masthead footer sidebar ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "cookie cookies consent gdpr popup modal newsletter subscribe breadcrumb breadcrumbs disqus pagination pager share sharing social signup".split()
)
COMMENTS = frozenset("comment comments responses".split())
#: These mark boilerplate only beside words of LAYOUT, or alone; the ones above beside those of OTHERS too.
WEAK_MARKS = frozenset(
    "header aside promotion promoted notice notices alert overlay subscription login reply replies respond discussion related recommended recommendations toolbar widget widgets search skip "
    "legal copyright disclaimer teaser teasers trending".split()
)
LAYOUT = frozenset(
    "site page global top bottom left right main primary secondary box bar block list links link items item posts articles stories section area container wrapper wrap inner outer row col panel "
    "form button buttons icon icons message msg to info".split()
)
OTHERS = frozenset(
    "user users reader readers visitor blog news forum thread google dfp facebook fb twitter wp js ui mod mega mini mobile desktop sticky fixed slot unit rail strip tray tool tools follow us email mail count counter "
    "add new all show hide toggle load more title heading label law policy accept bottombar topbar data view card cards group text tag tags category author meta avatar date time".split()
)
#: "commentlist", "usercomments" and the like in one word; "commentary" isn't one.
_COMMENTS = re.compile(r"(?:user|reader|post|fb|blog|article)?comments?(?:list|area|box|form|thread|section|wrap|wrapper|container|block|body|text|author|meta)?")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
LIKELY = frozenset("article content post entry story main body text".split())
#: Elements that are never boilerplate by class, as themes mark whole pages ("has-sidebar").
WHOLE = frozenset("html body main article".split())
SEMANTIC = ("article", "main")

#: A sibling container is small with under this share of the other's characters. A container is a menu with so many links, and so many times more characters in
#: links than outside.
SMALL, MENU_LINKS, MENU_TIMES = 0.1, 3, 2
#: Elements that a page has this share of its text in are read although their class marks boilerplate, so many at most, one inside of the other.
MOST, EXEMPT = 0.9, 4

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag. Quotes count where they follow "=" and are closed.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_GENERAL = re.compile(r"[\d/]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" \t\r\n/") else {}


def _marks(name: str) -> str:
    """What a class or id, such as "postHeader-2" (post, header), marks: "comments", "boilerplate" or nothing. All its words must be known: "share-price" is content."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in ("has", "no", "with", "is"):
        return ""
    said = [bool(w in COMMENTS or _COMMENTS.fullmatch(w)) for w in words]
    if all(c or w in MARKS or w in WEAK_MARKS or w in LAYOUT or w in OTHERS or w in LIKELY for c, w in zip(said, words)):
        ends = {words[0], words[-1]}
        if any(said) and (LIKELY.isdisjoint(words) or said[0] or said[-1]):
            return "comments"
        if not MARKS.isdisjoint(words) and (LIKELY.isdisjoint(words) or not MARKS.isdisjoint(ends)):  # "content-sidebar-wrap" holds both
            return "boilerplate"
    return "boilerplate" if not WEAK_MARKS.isdisjoint(words) and all(w in WEAK_MARKS or w in LAYOUT for w in words) else ""


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """Why an element is left out: "tag", "comments", "boilerplate" (by its class) or not at all."""
    if tag in DROPPED or tag == "header" and not in_article:
        return "tag"
    if not attributes:
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "tag"
    if attributes.get("role", "").lower() in ROLES:
        return "tag"
    if tag in WHOLE - {"article"} or tag == "header":
        return ""
    if tag == "article" and not in_article:  # "comment" may be the genre of a whole article; an id such as "comment-3" is a comment's
        return "comments" if _marks(attributes.get("id", "")) == "comments" else ""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    found = {_marks(n) for n in names}
    if "comments" in found:
        return "comments"
    content = any(words and LIKELY.issuperset(w.lower() for w in words) for words in map(_WORD.findall, names))
    return "boilerplate" if "boilerplate" in found and tag != "article" and not content else ""


class Page:
    """Pieces of text in order, and containers as ranges of them. Container 0 is the whole page; children come after their parents."""

    def __init__(self, page: str, exempt: frozenset[int] = frozenset()):
        # Elements left out for their class, by where they begin: characters inside. The largest are read after all if they have nearly all of the text.
        self._exempt, self._left_out = exempt, {}
        self.pieces: list[str] = []
        # Of each container: label, parent, first and last piece, characters outside and inside of links, links, whether in an article.
        self.labels, self.parents, self.starts, self.ends = [""], [-1], [0], [0]
        self.plain, self.linked, self.links, self.inside = [0], [0], [0], [False]
        self._keys = [xxhash.xxh64(seed=42)]
        self._read(page)
        self.ends[0] = len(self.pieces)
        most = max(self._left_out, key=self._left_out.get, default=None)
        if most is not None and len(exempt) < EXEMPT and self._left_out[most] > MOST * (sum(self.plain) + sum(self.linked) + sum(self._left_out.values())):
            self.__init__(page, exempt | {most})

    def _read(self, page: str) -> None:
        # Of each open element: tag, its container, boilerplate or not. where: positions of open elements by tag.
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        where: dict[str, list[int]] = defaultdict(list)
        pieces, last_end = self.pieces, page.rfind(">")
        dropped_at, quotes, left_out, silent = 0, True, None, 0  # left_out: where an element left out for its class begins; silent: depth at which its text doesn't count

        def close(to: int) -> None:
            nonlocal dropped_at, left_out, silent
            while len(stack) > to:
                tag, at, _ = stack.pop()
                where[tag].pop()
                if dropped_at == len(stack):
                    dropped_at, left_out, silent = 0, None, 0
                elif silent == len(stack):
                    silent = 0
                if at != stack[-1][1]:
                    self.ends[at] = len(pieces)

        def text(data: str) -> None:
            if left_out is not None and not silent:
                self._left_out[left_out] += len(data.strip())
            if not dropped_at and data:
                data = entities.unescape(data) if "&" in data else data
                pieces.append(data)
                (self.linked if where["a"] else self.plain)[stack[-1][1]] += len(data.strip())

        at = held = 0  # text from held to at isn't taken yet
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                text(page[held:at])
                end = page.find("-->", at + 4)
                at = held = len(page) if end < 0 else end + 3
                continue
            if at > last_end:
                break
            if page.startswith(("<!", "<?"), at):
                text(page[held:at])
                at = held = page.find(">", at) + 1
                continue
            m = _OPEN.match(page, at)
            if not m:
                at += 1
                continue
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:  # a quote runs past all tags: from here on the first ">" ends a tag
                quotes = False
                raw, end = page[m.end() : (close_at := page.find(">", m.end()))], close_at + 1
            else:
                raw, end = rest[1], rest.end()
            text(page[held:at])
            begin, at, held = at, end, end
            tag = m[2].lower()
            if tag in BLOCKS and not dropped_at:
                pieces.append("\n")
            if m[1]:
                k = where[tag][-1] if where[tag] else 0
                if k and (tag in BLOCKS or tag in DROPPED or k > max((where[c][-1] for c in CONTAINERS if where[c]), default=0)):
                    close(k)
                continue
            if tag in VOID:
                continue
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if ends:
                k = max((where[e][-1] for e in ends if where[e]), default=0)
                if k and k > max(dropped_at, *(where[c][-1] for c in (*CONTAINERS, *LISTS) if c not in ends and where[c]), 0):
                    close(k)
            attributes = _attributes(raw)
            parent = stack[-1][1]
            why = _boilerplate(tag, attributes, bool(where["article"] or where["main"])) if begin not in self._exempt else ""
            dropped = bool(dropped_at or why)
            if dropped and not dropped_at:
                dropped_at = len(stack)
                if why == "boilerplate":
                    left_out = begin
                    self._left_out[begin] = 0
            elif left_out is not None and not silent and why in ("tag", "comments"):
                silent = len(stack)
            own = parent
            if tag in CONTAINERS and not dropped:
                own = len(self.labels)
                classes = sorted({_GENERAL.sub("", c).lower() for c in attributes.get("class", "").split()} - {""})
                self._open(".".join([tag, *classes]), parent, bool(where["article"]))
            elif tag == "a" and not dropped:
                self.links[parent] += 1
            where[tag].append(len(stack))
            stack.append((tag, own, dropped))
            if tag in RAW and not raw.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = held = end + 1 if end >= 0 else len(page)
                close(len(stack) - 1)
        text(page[held:])
        close(1)

    def _open(self, label: str, parent: int, in_article: bool) -> None:
        key = self._keys[parent].copy()
        key.update("/" + label)
        for column, value in ((self.labels, label), (self.parents, parent), (self.starts, len(self.pieces)), (self.ends, 0), (self.plain, 0), (self.linked, 0), (self.links, 0), (self.inside, in_article), (self._keys, key)):
            column.append(value)

    def _tag(self, i: int) -> str:
        return self.labels[i].partition(".")[0]

    def _totals(self, column: list[int]) -> list[int]:
        out = list(column)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def choice(self) -> int | None:
        """The container that holds the page's main text; None if it has none."""
        own = [p - q for p, q in zip(self.plain, self.linked)]
        score = list(map(float, own))
        for i in range(1, len(own)):
            score[self.parents[i]] += 0.5 * own[i]
        for i, label in enumerate(self.labels):
            score[i] *= 1.5 if not LIKELY.isdisjoint(re.split(r"[.-]", label)) else 1.0 if i else 0.25
        best = max(range(len(own)), key=lambda i: (score[i], -self.starts[i], self.ends[i]))
        if score[best] <= 0:
            return None
        up = [best]
        while up[-1] > 0:
            up.append(self.parents[up[-1]])
        semantic = [i for i in up if self._tag(i) in SEMANTIC]
        return semantic[-1] if semantic else self._widened(up)

    def _widened(self, up: list[int]) -> int:
        plain, on_way = self._totals(self.plain), dict(zip(up[1:], up))
        largest = dict.fromkeys(up[1:], 0)  # sibling of the container on the way up
        for i in range(1, len(plain)):
            p = self.parents[i]
            if p in largest and on_way[p] != i and not self._is_menu(i):
                largest[p] = max(largest[p], plain[i])
        out = up[0]
        for p in up[1:]:
            if self.plain[p] > self.linked[p] or largest[p] > 0 and largest[p] >= SMALL * plain[on_way[p]]:
                out = p
        return out

    def _is_menu(self, i: int) -> bool:
        if not hasattr(self, "_all"):
            self._all = self._totals(self.plain), self._totals(self.linked), self._totals(self.links)
        plain, linked, links = self._all
        return links[i] >= MENU_LINKS and linked[i] > MENU_TIMES * plain[i]

    def path(self, i: int) -> str:
        labels = []
        while i > 0:
            labels.append("/" + self.labels[i])
            i = self.parents[i]
        return "".join(reversed(labels))

    def on(self, key: int | None) -> list[int]:
        """Containers whose path has this hash, those inside of others left out."""
        out: list[int] = []
        for i, k in enumerate(self._keys):
            if k.intdigest() == key and (not out or self.starts[i] >= self.ends[out[-1]]):
                out.append(i)
        return out

    def text(self, ranges: list[int]) -> str:
        """The pieces of the containers, in order and apart from each other, without menus inside of them."""
        out: list[str] = []
        menus = iter([i for i in range(1, len(self.labels)) if not self.inside[i] and self._is_menu(i)])
        menu = next(menus, None)
        for r in ranges:
            at = self.starts[r]
            while menu is not None and (menu <= r or self.starts[menu] < self.ends[r]):
                if menu > r and self.starts[menu] >= at:
                    out += self.pieces[at : self.starts[menu]]
                    at = self.ends[menu]
                menu = next(menus, None)
            out += [*self.pieces[at : self.ends[r]], "\n"]
        return " ".join("".join(out).split())


def path_key(path: str) -> int:
    """The hash of a path, as Spark's xxhash64 has it but unsigned."""
    return xxhash.xxh64_intdigest(path, seed=42)


def vote(page: str | None) -> str | None:
    """The path of the page's own choice; null if the page has no text."""
    if not page:
        return None
    read = Page(page)
    found = read.choice()
    return None if found is None else read.path(found)


def extract(page: str | None, key: int | None) -> str:
    """The text of the containers on the path of this hash; that of the page's own choice if there is none, or it is small beside an article of the page's own."""
    if not page:
        return ""
    read = Page(page)
    choice = read.choice() or 0
    found = read.text(read.on(key))
    if found and read._tag(choice) not in SEMANTIC:
        return found
    own = read.text([choice])
    return own if len(found) < SMALL * len(own) else found


def _host(url_col: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, votes, pages): each host's winning path, null without votes, the votes for it, and the rows of the host."""
    rows = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    votes = common.map_batches(rows, lambda: lambda h: {"path": [vote(x) for x in h]}, ["html"], "path string").drop("html")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    least = F.when(F.col("path").isNotNull(), F.struct(-F.col("votes"), F.col("path")))
    return counted.groupBy("host").agg(F.min_by("path", least).alias("path"), F.max(F.when(F.col("path").isNotNull(), F.col("votes"))).alias("votes"), F.sum("votes").alias("pages"))


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with text, its main text. The winners, a row of a hash for each host, are broadcast within common.BROADCAST_ROWS; beyond that hosts with many pages are, and only
    pages of the others move, once."""
    winners = common.materialize(host_paths(pages, html_col, url_col).select("host", F.xxhash64("path").alias("key"), "pages"), "host-paths")
    rows = common.packed(pages.withColumn("_host", _host(url_col)), html_col, "_host").withColumnsRenamed({html_col: "html", "_host": "host"})
    found = common.spread_lookup(rows, winners, "host", "pages")
    unsigned = lambda k: None if k is None else k % (1 << 64)
    out = common.map_batches(found.drop("host", "pages"), lambda: lambda h, k: {"text": [extract(x, unsigned(y)) for x, y in zip(h, k)]}, ["html", "key"], "text string")
    return out.select(*common.unpacked(out, [c for c in pages.columns if c != "text"], **{html_col: "html"}), "text")


def op10_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

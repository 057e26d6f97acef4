"""Main-text extraction by equivalence-class template deduction over pages of one host.

The pages of a host are dealt into blocks of a bounded number of pages and bytes.  In a
block each page is a sequence of tokens: its tags, named by the path they stand in, their
name, class, id and role, and its texts, one for each run between tags that break a line.

1. Tokens with equal occurrence vectors (how often each page has them) form an equivalence
   class.  A class is valid if enough pages have it, it has two tokens at least, and on
   every page its tokens come in rounds of one order: one round where the vector is of
   ones, several for the items of a list.
2. Valid classes are nested: a round of one class must lie between two neighbouring tokens
   of a round of another.  Of two classes that cross on some page the one on fewer pages
   goes.  What is left is a tree, the template.
3. The places between neighbouring tokens of a round are the slots.  Texts that are template
   tokens themselves belong to the template and go; the texts that fill slots stay, if their
   slot is in the main region.  Tag names serve for that choice only: a slot in a menu,
   header, footer, sidebar, notice, advert, form, script, style or comment section goes,
   and where any page has an article or main element, or else an element with a telling
   class, only slots within those stay.

A text counts as template only on most of the pages that have the tag that opens it; inside
a marked main region that tag must be of the same class, or PARAGRAPH_PAGES pages show the
text: a short block of pages may share a paragraph by chance.  Pages with one main text count once, and get one result.  Where a
block has fewer than LEAST_PAGES pages that differ there is no template, and all text of
the main region stays.

Edge cases: null or empty html gives an empty text; a null url belongs to the host '';
unclosed tags end with their parent; a '<' that opens no tag is text; a very long page is
read in time proportional to its length, however deep its elements nest; repeated rows
give equal rows; classes on as many pages tie by their number of tokens and then by the
tokens; an empty table gives an empty result; columns other than id, url and html play
no part, whatever their names.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pages of a host that one task compares, about, and their bytes.
BLOCK_PAGES = 256
BLOCK_BYTES = 16 << 20
LEAST_PAGES = 3
#: Pages that have a text before it counts as template without a tag of its own.
PARAGRAPH_PAGES = 8
#: Hosts with several blocks are broadcast up to this many, and joined beyond.
BROADCAST_HOSTS = 200_000

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea noscript template iframe svg object canvas xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub "
    "msup mtext q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_UNSEEN = frozenset(("script", "style", "template"))
_OUTSIDE = frozenset("head nav header footer aside form menu dialog button select option fieldset".split()) | _RAW
_MAIN = frozenset(("article", "main"))
_CLOSES = {
    "p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"),
    "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",),
}
_BLOCKS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol form".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ENDS = {name: re.compile(rf"</{name}(?![\w-])", re.I | re.A) for name in _RAW}

#: Words of a class, id or role that alone, or as the first of a hyphenated name, mark what is no part of an article.
_AWAY_FIRST = re.compile(
    r"(?:ad|ads|adsense|advert\w*|banner|sponsor\w*|promo\w*|side-?bar\w*|aside|menu\w*|nav|navbar|navigation|breadcrumbs?|masthead"
    r"|foot|footer|copyright|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|commentlist|reply|replies|respond|disqus"
    r"|discussion|newsletter|subscribe|signup|login|search|social|share|sharing|related|recommend\w*|widget|pagination|pager|toolbar|skip"
    r"|banner|contentinfo|complementary)(?:[_-]|$)", re.I
)
#: The same as the last word after any other.
_AWAY_LAST = re.compile(
    r"[_-](?:ads?|adverts?|advertisement|sponsor(?:ed|s)?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|comments|commentlist|disqus"
    r"|newsletter|widget|pagination|pager)$", re.I
)
#: The same after a word that says whose it is; an article's own header, or "market-share", isn't meant.
_AWAY_PAIR = re.compile(
    r"^(?:site|page|web|global|top|main|blog)[_-](?:header|banner|alert|notice|search|login)$|^(?:cookie|privacy|gdpr|legal)[_-]\w+$"
    r"|^(?:post|entry|article|social)[_-](?:share|sharing|related)$", re.I
)
_ASIDE = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|related|recommend\w*|teaser\w*|widget)(?:$|[_-])", re.I)
_CONTENT = re.compile(r"^(?:[a-z]+[_-])?(?:article|content|post|entry|story|main|text|body)(?:[_-]?(?:body|content|text|main))?$", re.I)
_WITHOUT = re.compile(r"(?:no|not|with|without|has|hide|hidden)[_-]", re.I)


class Element:
    """An open element: what its ancestors and itself say about the text in it."""

    __slots__ = ("name", "outside", "inside", "article", "path", "body")

    def __init__(self, name: str, marks: str, above: "Element | None"):
        self.name = name
        self.article = name == "article" or (above is not None and above.article)
        self.outside = (above is not None and above.outside) or outside(name, marks, above is not None and above.article)
        self.inside = max(above.inside if above else 0, inside(name, marks))
        self.body = name == "body" or (above is None or above.body) and name != "html"
        path = above.path if above else 0
        self.path = path if name in _INLINE or name == "p" else xxhash.xxh3_64_intdigest(f"{path}/{name}")


def _words(marks: str) -> list[str]:
    """Class, id and role words, without those that say what an element goes without or beside."""
    return [w for v in re.split(r"(?:^| )(?:class|id|role)=", marks) for w in v.split() if not _WITHOUT.match(w)]


def outside(name: str, marks: str, in_article: bool) -> bool:
    """Whether an element is no part of the main text; an article's own header, with its title, is."""
    if name == "header" and in_article:
        return False
    if name in _OUTSIDE:
        return True
    if not marks or name in ("html", "body"):
        return False
    words = _words(marks)
    if name in _MAIN:
        return any(_ASIDE.search(w) for w in words)
    if not in_article and any(w.lower() == "header" for w in words):
        return True
    return any(_AWAY_FIRST.match(w) or _AWAY_LAST.search(w) or _AWAY_PAIR.match(w) for w in words)


def inside(name: str, marks: str) -> int:
    """How clearly an element marks the main region: 2 for an article or main element, 1 by its class or id."""
    if name in _MAIN or "role=main" in marks or "role=article" in marks:
        return 2
    return 1 if name in ("div", "section", "td") and any(_CONTENT.match(w) for w in _words(marks)) else 0


class Ends:
    """Where each tag of a page ends: at the first '>' outside quotes, or else the first '>'.

    A pattern finds that while it succeeds.  The first failure may have read to the page's end,
    so from then on the ends come from a table that is filled from the end once.
    """

    def __init__(self, text: str):
        self.text = text
        self.marks: list[int] | None = None
        self.end: list[int] = []

    def __call__(self, at: int) -> int:
        """The place of the '>' that ends the tag whose name ends at `at`; one follows."""
        if self.marks is None:
            m = _REST.match(self.text, at)
            if m:
                return m.end() - 1
            self._fill()
        found = self.end[bisect.bisect_left(self.marks, at)]
        return found if found >= 0 else self.text.index(">", at)

    def _fill(self) -> None:
        self.marks = [m.start() for m in _MARK.finditer(self.text)]
        plain = double = single = -1  # where a tag ends that is read on from here, outside and within quotes
        for p in reversed(self.marks):
            c = self.text[p]
            if c == ">":
                plain = p
            elif c == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.end.append(plain)
        self.end.reverse()


class Text:
    """A text between tags that break lines: its place among the page's tokens, its opening tag, and where it stands."""

    __slots__ = ("at", "opener", "line", "pieces", "value", "before", "after", "outside", "inside", "body")

    def __init__(self, at: int, opener: int, line: int, where: Element | None):
        self.at, self.opener, self.line, self.pieces, self.value = at, opener, line, [], ""
        self.before = self.after = False  # white space at its ends
        self.outside = where.outside if where else False
        self.inside = where.inside if where else 0
        self.body = where.body if where else True


class Page:
    """The tokens of a page, tags and texts in one sequence, and its texts."""

    def __init__(self, text: str):
        self.tokens: list[str] = []
        self.texts: list[Text] = []
        self._stack: list[Element] = []
        self._open: dict[str, list[int]] = defaultdict(list)
        self._scopes: list[int] = []
        self._run: Text | None = None
        self._opener = -1
        self._line = 0
        self._read(text)
        self._close_run()

    def _read(self, text: str) -> None:
        at, end, last, ends = 0, len(text), text.rfind(">"), Ends(text)
        while at < end:
            start = text.find("<", at)
            if start < 0 or start > last:  # nothing after the last '>' opens a tag
                self._put(text[at:])
                return
            self._put(text[at:start])
            if text.startswith("<!--", start):
                stop = text.find("-->", start + 4)
                at = end if stop < 0 else stop + 3
                continue
            if text.startswith(("<!", "<?"), start):
                at = text.index(">", start) + 1
                continue
            m = _NAME.match(text, start)
            if m is None:
                self._put("<")
                at = start + 1
                continue
            stop = ends(m.end())
            at, name, rest = stop + 1, m[2].lower(), text[m.end() : stop]
            if name == "br":
                self._put("\n")
            elif name not in _INLINE and name not in _UNSEEN:
                self._close_run()
                self._line += 1
            if m[1]:
                self._end_tag(name)
            else:
                self._start_tag(name, rest)
                if name in _RAW and not rest.endswith("/"):
                    stop = _ENDS[name].search(text, at)
                    at = stop.start() if stop else end

    def _put(self, piece: str) -> None:
        if not piece:
            return
        top = self._stack[-1] if self._stack else None
        run = self._run
        if run is None or (run.outside, run.inside) != (top.outside if top else False, top.inside if top else 0):
            self._close_run()
            run = self._run = Text(len(self.tokens), self._opener, self._line, top)
        run.pieces.append(piece)

    def _close_run(self) -> None:
        run, self._run = self._run, None
        if run is None:
            return
        raw = _html.unescape("".join(run.pieces))
        run.value, run.pieces = " ".join(raw.split()), []
        run.before, run.after = raw[:1].isspace(), raw[-1:].isspace()
        if run.value:
            run.at = len(self.tokens)
            self._token(f'"{run.value}')
            self.texts.append(run)

    def _token(self, what: str) -> None:
        path = self._stack[-1].path if self._stack else 0
        self.tokens.append(f"{path:x}>{what}")

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            e = self._stack.pop()
            self._open[e.name].pop()
            if e.name in _SCOPE:
                self._scopes.pop()

    def _end_tag(self, name: str) -> None:
        places = self._open.get(name)
        if places:
            self._pop_to(places[-1])
        self._token(f"/{name}")

    def _start_tag(self, name: str, rest: str) -> None:
        marks = " ".join(sorted(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in _ATTRIBUTE.findall(rest)))
        shut = _CLOSES.get(name) or (("p",) if name in _BLOCKS_P else ())
        floor = self._scopes[-1] if self._scopes else -1
        spots = [self._open[s][-1] for s in shut if self._open.get(s)]
        spots = [k for k in spots if k > floor]
        if spots:
            self._pop_to(min(spots))
        self._token(f"{name} {marks}".strip())
        if name not in _INLINE:
            self._opener = len(self.tokens) - 1
        if name in _VOID or name in _RAW or rest.rstrip().endswith("/"):
            return
        self._open[name].append(len(self._stack))
        if name in _SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append(Element(name, marks, self._stack[-1] if self._stack else None))


def equivalence_classes(pages: list[Page]) -> list[tuple[tuple[tuple[int, int], ...], list[str]]]:
    """(occurrence vector as (page, count) pairs, tokens in the order of a round) of each valid class."""
    where: dict[str, dict[int, list[int]]] = defaultdict(dict)
    for k, p in enumerate(pages):
        for i, t in enumerate(p.tokens):
            where[t].setdefault(k, []).append(i)
    classes: dict[tuple, list[str]] = defaultdict(list)
    for t, places in where.items():
        classes[tuple((k, len(x)) for k, x in sorted(places.items()))].append(t)
    valid = []
    for vector, tokens in classes.items():
        if len(vector) < LEAST_PAGES or len(tokens) < 2:
            continue
        first = vector[0][0]
        order = sorted(tokens, key=lambda t: where[t][first][0])
        if all(_in_rounds([where[t][k] for t in order], n) for k, n in vector):
            valid.append((vector, order))
    return valid


def _in_rounds(places: list[list[int]], rounds: int) -> bool:
    """Whether the tokens come in the given order, round after round."""
    before = -1
    for r in range(rounds):
        for p in places:
            if p[r] < before:
                return False
            before = p[r]
    return True


def nest(classes: list[tuple[tuple, list[str]]], pages: list[Page]) -> list[tuple[tuple, list[str]]]:
    """The classes without those whose rounds cross a round of another (a b a b); that on more pages, then with more tokens, stays."""
    classes = sorted(classes, key=lambda c: (-len(c[0]), -len(c[1]), c[1]))
    member = {t: (c, i) for c, (_, tokens) in enumerate(classes) for i, t in enumerate(tokens)}
    gone: set[int] = set()
    for page in pages:
        open_: list[int] = []
        at: set[int] = set()
        for t in page.tokens:
            c, i = member.get(t, (-1, 0))
            if c < 0 or c in gone:
                continue
            if i == 0:
                open_.append(c)
                at.add(c)
            elif c not in at:
                continue
            while open_[-1] != c:  # the top has tokens to come: it crosses c
                if open_[-1] < c:
                    gone.add(c)
                    open_.remove(c)
                    at.discard(c)
                    break
                top = open_.pop()
                gone.add(top)
                at.discard(top)
            if c not in gone and i == len(classes[c][1]) - 1:
                open_.pop()
                at.discard(c)
    return [x for c, x in enumerate(classes) if c not in gone]


def templates(pages: list[Page]) -> list[set[str]]:
    """The template tokens of each page."""
    out: list[set[str]] = [set() for _ in pages]
    for vector, tokens in nest(equivalence_classes(pages), pages):
        for k, _ in vector:
            out[k].update(tokens)
    return out


class Template:
    """The nested classes of a block: which class each token is of, and how many pages have it."""

    def __init__(self, pages: list[Page]):
        self.of: dict[str, int] = {}
        self.support: list[int] = []
        self.once: list[bool] = []
        self.size: list[int] = []
        self.having = Counter(t for p in pages for t in set(p.tokens))
        for c, (vector, tokens) in enumerate(nest(equivalence_classes(pages), pages)):
            self.of |= dict.fromkeys(tokens, c)
            self.support.append(len(vector))
            self.once.append(all(n == 1 for _, n in vector))
            self.size.append(len(tokens))

    def slots(self, page: Page) -> list[tuple[int, int]]:
        """(class, gap) of each text: the innermost round that is open there and how many of its tokens came before."""
        out, open_, k = [], [], 0
        for i, t in enumerate(page.tokens):
            text = k < len(page.texts) and page.texts[k].at == i
            c = self.of.get(t, -1)
            if c >= 0:
                if open_ and open_[-1][0] == c:
                    open_[-1][1] += 1
                else:
                    open_.append([c, 1])
                if open_[-1][1] >= self.size[c]:
                    open_.pop()
            if text:
                out.append(tuple(open_[-1]) if open_ else (-1, 0))
                k += 1
        return out

    def fixed(self, page: Page, text: Text, marked: bool) -> bool:
        """Whether a text is part of the template."""
        c = self.of.get(page.tokens[text.at], -1)
        if c < 0 or not self.once[c]:
            return False
        opener = page.tokens[text.opener] if text.opener >= 0 else page.tokens[text.at]
        if 2 * self.support[c] <= self.having[opener]:
            return False
        return not marked or self.support[c] >= PARAGRAPH_PAGES or self.of.get(opener, -2) == c


def region(page: Page) -> int:
    """How clearly the page marks a main region."""
    return max((t.inside for t in page.texts if not t.outside), default=0)


def by_tags(page: Page) -> list[Text]:
    """The texts of a page that its tags alone call main."""
    best = region(page)
    return [t for t in page.texts if not t.outside and t.inside >= best and (best or t.body)]


def extract(texts: list[str]) -> list[str]:
    """The main text of each page of a block, whatever their order."""
    pages = {t: Page(t) for t in sorted(set(texts))}
    main = {t: tuple(x.value for x in by_tags(p)) for t, p in pages.items()}
    witness: dict[tuple, str] = {}
    for t, x in main.items():
        witness.setdefault(x, t)
    shown = [pages[t] for t in witness.values()]
    template = Template(shown)
    own = {x: _main_text(pages[t], template, votes) for votes in [_slot_votes(shown, template)] for x, t in witness.items()}
    return [own[main[t]] for t in texts]


def _slot_votes(pages: list[Page], template: Template) -> Counter:
    """For each slot by how many texts tags call it outside rather than not."""
    votes: Counter = Counter()
    for p in pages:
        for t, slot in zip(p.texts, template.slots(p), strict=True):
            votes[slot] += 1 if t.outside else -1
    return votes


def _main_text(page: Page, template: Template, votes: Counter) -> str:
    """What fills the slots of the main region; a slot that tags call outside on most pages is so on all, unless a region is marked."""
    best = region(page)
    kept = []
    slots = {id(t): s for t, s in zip(page.texts, template.slots(page), strict=True)}
    for t in by_tags(page):
        slot = slots[id(t)]
        if template.fixed(page, t, best > 0) or not best and slot[0] >= 0 and votes[slot] > 0:
            continue
        kept.append(t)
    out: list[str] = []
    for i, t in enumerate(kept):
        if i and kept[i - 1].line == t.line:  # around an inline element that goes
            out += [" " if kept[i - 1].after or t.before else "", t.value]
        else:
            out += ["\n\n" if i else "", t.value]
    return "".join(out)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_pages: int = BLOCK_PAGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, url, text) of every page row."""
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), host.alias("host"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    needed = F.ceil(F.greatest(F.col("n") / block_pages, F.col("bytes") / block_bytes))
    busy = sizes.select("host", needed.alias("blocks")).where("blocks > 1")
    few = busy.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(busy) if few else busy, "host", "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "url"), F.coalesce("blocks", F.lit(1).cast("long")))).drop("blocks")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def block(table: pa.Table) -> pa.Table:
        texts = extract(table.column("html").to_pylist())
        return pa.table({id_col: table.column("id"), url_col: table.column("url"), "text": pa.array(texts, pa.string())})

    return dealt.groupBy("host", "block").applyInArrow(block, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string")

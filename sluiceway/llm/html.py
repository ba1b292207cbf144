"""Main text of web pages through wrappers inferred per host.

Pages of a host are aligned, one after the other, to a union-free regular
expression over their token streams (the wrapper): start and end tags, text
slots, optional groups and repeated groups. Where a page and the wrapper differ,
texts become slots; a run of siblings that comes once more right behind itself (a square, of one element or several)
becomes a repeated group; and parts that only one has become optional groups. A wrapper's slot knows
which texts every page had there. These are template text, inside the article as well as outside; a block goes if
all of it is template text. The article is the region marked as such, or else
the node whose slots hold the most text that isn't links. Words in class, id and role only tell apart what the
alignment can't, such as adverts and reader comments that differ on every page; they never remove a paragraph, heading or list item.

A wrapper is inferred from all pages of a group, folded page by page; a second pass
extracts every page from its whole html. Copies (pages with the same text
outside menus and the like) count as one page, and template text that makes up more than half of
a page's article is kept (near copies share that much, templates don't); it takes three different pages to know a template. A page that
doesn't fit the wrapper is judged by its own tokens. Hosts with many pages are
dealt into several groups, each with a wrapper of its own; a group's html is held compressed.

Edge cases: null or empty html gives the empty text; a null url is a host of its
own; broken markup (unclosed or crossing tags, stray '<') is read as far as it
goes; elements nested deeper than ``DEEPEST`` are read as if at that depth; a page alone on its host is judged by its own tokens; repeated rows are
extracted each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import counted_side, map_arrow

#: Pages of one host in a group; hosts with more are dealt into several.
GROUP = 250
#: Elements below one another that are told apart.
DEEPEST = 200
#: Siblings that may repeat as one group.
SQUARE = 8
#: Different pages that it takes to tell a template's text from an article's.
PAGES = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NUMBER = re.compile(r"\d+")
# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu head input option fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select article section div main body".split())
SAID = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption article main body html".split())
# Words in class, id or role that mark what isn't the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|"
    r"disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|search|share|"
    r"sharing|sidebar|social|sponsor|sponsored|subscribe|subscription|toc|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|post-body|entry-content|article-body|post-content)(?:$|[\s_-])", re.I)


class Node:
    """An element of a page."""

    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def key(self) -> tuple[str, str]:
        return self.tag, self.marks


def parse(text: str | None) -> Node:
    """Token stream to nested elements; text is kept undecoded."""
    root = Node("#page")
    stack, at, text = [root], 0, text or ""
    below: list[str] = []  # open elements that are too deep to be told apart

    def say(part: str) -> None:
        if part:
            stack[-1].children.append(part)

    def close(names: tuple[str, ...], scopes: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in scopes:
                return

    for m in TOKEN.finditer(text):
        say(text[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name in below:
                while below.pop() != name:
                    pass
            else:
                close((name,), frozenset())
            continue
        if len(stack) > DEEPEST:
            if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                below.append(name)
            if name not in INLINE:
                stack[-1].children.append(Node("br"))
            continue
        if name in CLOSES_P:
            close(("p",), SCOPES)
        if name in SIBLINGS:
            close(SIBLINGS[name], SCOPES)
        marks = " ".join(sorted(x[1] or x[2] or x[3] or x[0] for x in ATTR.findall(m["attrs"]))) if m["attrs"] else ""
        marks = NUMBER.sub("0", marks)  # ids often count pages
        node = Node(name, marks)
        stack[-1].children.append(node)
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append(node)
    say(text[at:])
    return root


class Wrapper:
    """A node of the expression: an element or a text slot, maybe optional or repeated."""

    __slots__ = ("key", "seen", "repeated", "text", "texts", "chars", "linked", "children", "keys")

    def __init__(self, key: object):
        self.key, self.seen, self.repeated, self.text = key, 0, False, None
        self.texts: dict[int, int] = {}
        self.keys: set[object] = set()
        self.chars = self.linked = 0
        self.children: list[Wrapper] = []

    def optional(self, of: int) -> bool:
        return self.seen < of

    def say(self, said: str, in_link: bool, page: int) -> None:
        """One more text of a slot. ``texts`` has, of the first page's texts, the last page up to which every page had it."""
        self.text = said if self.seen == 1 or self.text == said else False
        self.chars += len(said)
        self.linked += len(said) * in_link
        name = xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass"))
        if page == 0 or self.texts.get(name) == page - 1:
            self.texts[name] = page

    def square(self, keys: list[object], i: int, at: int) -> int:
        """How many siblings before ``at`` come once more from keys[i] on; the fewest, or 0."""
        for n in range(1, min(SQUARE, at, len(keys) - i) + 1):
            if all(self.children[at - n + k].key == keys[i + k] for k in range(n)):
                return n
        return 0

    def absorb(self, node: Node | str, in_link: bool = False, page: int = 0) -> None:
        """Align one more element with this node; pages are numbered from 0, copies of one have the number -1."""
        self.seen += 1
        if isinstance(node, str):
            self.say(" ".join(references.unescape(node).split()), in_link, page)
            return
        fresh = [x for x in node.children if not isinstance(x, str) or x.strip()]
        keys = ["#" if isinstance(x, str) else x.key for x in fresh]
        at = i = 0
        while i < len(fresh):
            if i and (n := self.square(keys, i, at)):
                for k in range(n):
                    group = self.children[at - n + k]
                    group.repeated = True
                    group.absorb(fresh[i + k], in_link or keys[i + k][0] == "a", page)
                i += n
                continue
            key = keys[i]
            for j in range(at, len(self.children) if key in self.keys else at):
                if self.children[j].key == key:
                    break
            else:  # only this page has it: an optional group from here on
                j = at
                self.children.insert(at, Wrapper(key))
                self.keys.add(key)
            self.children[j].absorb(fresh[i], in_link or key[0] == "a", page)
            at, i = j + 1, i + 1


def infer(pages: list[Node]) -> Wrapper:
    w = Wrapper(("#page", ""))
    for i, p in enumerate(pages):
        w.absorb(p, page=i)
    return w


def outside(key: object) -> bool:
    """By its element or, if it isn't one that holds an article's text, by its class words."""
    return isinstance(key, tuple) and (key[0] in OUTSIDE or key[0] not in SAID and bool(key[1] and MARKS.search(key[1])))


def region(w: Wrapper) -> list[object] | None:
    """Path of keys from the page to the article."""

    def marked(x: Wrapper, path: list[object], test) -> list[object] | None:
        for c in x.children:
            if isinstance(c.key, tuple) and not outside(c.key):
                if test(c.key):
                    return [*path, c.key]
                if (got := marked(c, [*path, c.key], test)) is not None:
                    return got
        return None

    for test in (lambda k: k[0] == "article", lambda k: k[0] == "main", lambda k: bool(k[1] and ARTICLE.search(k[1]))):
        if (got := marked(w, [], test)) is not None:
            return got

    def text(x: Wrapper) -> int:
        if outside(x.key):
            return 0
        own = x.chars - 2 * x.linked if x.key == "#" and not (x.seen >= PAGES and x.text) else 0
        return own + sum(map(text, x.children))

    path, now = [], w
    while True:  # down as long as one child has nearly all of the text
        total = text(now)
        best = max((c for c in now.children if isinstance(c.key, tuple) and not outside(c.key) and c.key[0] not in INLINE), key=text, default=None)
        if best is None or best.repeated or total <= 0 or text(best) < 0.8 * total:
            return path
        path, now = [*path, best.key], best


def blocks(node: Node, aligned: list[Wrapper], pages: int, inside: bool) -> list[str]:
    """Text blocks of an element without template text; ``aligned`` are the wrapper nodes it can be aligned with."""
    out: list[tuple[str, bool]] = []
    line: list[tuple[str, bool]] = []

    def flush() -> None:
        said = " ".join("".join(x for x, _ in line).split())
        if said:
            out.append((said, all(fixed for x, fixed in line if x.strip())))
        line.clear()

    def walk(n: Node, aligned: list[Wrapper], soft: bool) -> None:
        if outside(n.key) and not (inside and n.tag == "header"):
            if n.tag not in INLINE:
                flush()
                return
            if n.tag in OUTSIDE:
                return
            soft = True  # marked words of a line count only if the line has others
        slots: dict[object, list[Wrapper]] = {}
        for w in aligned:
            for c in w.children:
                slots.setdefault(c.key, []).append(c)
        template = {name for w in slots.get("#", ()) for name, upto in w.texts.items() if upto == pages - 1} if pages >= PAGES else ()
        for c in n.children:
            if isinstance(c, str):
                said = references.unescape(c)
                fixed = soft or bool(template) and xxhash.xxh3_64_intdigest(" ".join(said.split()).encode("utf-8", "surrogatepass")) in template
                line.append((said, fixed))
            elif c.tag == "br":
                line.append((" ", True))
            elif c.tag in INLINE:
                walk(c, slots.get(c.key, []), soft)
            else:
                flush()
                walk(c, slots.get(c.key, []), False)
                flush()

    walk(node, aligned, False)
    flush()
    own = [said for said, fixed in out if not fixed]
    every = [said for said, _ in out]
    return own if 2 * sum(map(len, own)) >= sum(map(len, every)) else every


def find(node: Node, path: list[object]) -> list[Node]:
    """All elements of a page at a path of keys; document order."""
    now = [node]
    for key in path:
        now = [c for n in now for c in n.children if isinstance(c, Node) and c.key == key]
    return now


class Extractor:
    """A wrapper with its article's place, looked up once for all its pages."""

    def __init__(self, w: Wrapper, pages: int):
        self.pages, self.path = pages, region(w) or []
        self.inside = bool(self.path and (self.path[-1][0] in ("article", "main") or ARTICLE.search(self.path[-1][1] or "")))
        self.top, self.at = [w], [w]
        for key in self.path:
            self.at = [c for x in self.at for c in x.children if c.key == key]

    def text(self, page: Node) -> str:
        found = find(page, self.path) if self.path else []
        if self.path and not found and self.pages > 1:  # the page doesn't fit: judge it by its own tokens
            return Extractor(infer([page]), 1).text(page)
        whole = found or [page]
        return "\n\n".join(b for n in whole for b in blocks(n, self.at if found else self.top, self.pages, self.inside))


def packed(text: str | None) -> bytes:
    return zlib.compress((text or "").encode("utf-8", "surrogatepass"), 1)


def unpacked(blob: bytes) -> str:
    return zlib.decompress(blob).decode("utf-8", "surrogatepass")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    busy = counted_side(rows.groupBy("host").count().where(F.col("count") > GROUP).withColumnRenamed("host", "h"))
    dealt = rows.join(busy, F.col("host") == F.col("h"), "left").withColumn(
        "salt", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("count") / GROUP)))
    )
    sorted_ = dealt.select("page_id", "url", "html", "host", "salt").repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("host", "salt", "page_id", "url", "html")), strict=True)

        held: list[tuple] = []
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            w, copies = Wrapper(("#page", "")), set()
            for x in held:
                tree = parse(unpacked(x[2]))
                said = hashlib.blake2b("\n".join(blocks(tree, [], 1, False)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                w.absorb(tree, page=-1 if said in copies else len(copies))
                copies.add(said)
            extractor = Extractor(w, len(copies))
            for i in range(0, len(held), 256):
                ids, urls, htmls = zip(*held[i : i + 256], strict=True)
                texts = [extractor.text(parse(unpacked(x))) for x in htmls]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
            held.clear()

        for host, salt, page_id, url, text in stream():
            if (host, salt) != now:
                if held:
                    yield from settle()
                now = host, salt
            held.append((page_id, url, packed(text)))
        if held:
            yield from settle()

    return map_arrow(sorted_, run, "page_id long, url string, text string")

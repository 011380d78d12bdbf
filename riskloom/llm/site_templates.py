"""Main text of web pages by site template removal.

Every page is parsed once into text blocks, and every block element subtree gets a hash of its tags and text.
Spark counts on how many different pages of a host each hash occurs; blocks inside a subtree that recurs on
many of them are deleted.  Menus, adverts and footers may change their words from page to page: subtrees that
the markup names as furniture (``nav``, ``footer``, class ``ad`` ...), and lists of links, get a second hash
of their tags and class names alone, counted in the same way.

What names decide.  Elements that show no prose (scripts, styles, head, form controls) are left out.  Every
other name is evidence only.  It lets the second hash be counted, and that hash makes a template only if such
subtrees hold at most ``MOST`` of the text of their pages; a single one that holds most of its page and is far
longer than usual stays.  A named subtree that does not recur is dropped only if it is at most ``LOW_SHARE`` of
its page, and only while all of these together are at most ``MOST`` of it.  A name that is one part of a
compound class (``has-sidebar``, ``article-header``) counts only around links and without a heading of the page.

Shared passages.  Paragraphs and headings inside ``<article>`` are templates only if they stand on at least
``ARTICLE_SHARE`` of the host's different pages: a sentence that several articles quote is part of each, a line
that ends every article is not.  Text outside an article is treated like any other.

Pages that are copies of one another count once (counts are over distinct page bodies without named
furniture), so a mirrored article is not taken for a template.

Defined results: null or empty html, or html without text, gives an empty text; a null url is a host of its
own; repeated rows give repeated results; unclosed elements end where a following block or the input ends;
``n_blocks`` counts all blocks of a page, ``n_template_blocks`` those in recurring subtrees; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, hot_floor, stored

#: A subtree is template when it occurs on at least this many different pages of a host ...
MIN_PAGES = 3
#: ... and on this share of the host's different pages or, on hosts where that is more, on ``MANY_PAGES`` pages.
MIN_SHARE = 0.25
MANY_PAGES = 10
#: The share of the host's different pages for paragraphs and headings inside articles.
ARTICLE_SHARE = 0.5
#: Named furniture is at most this share of the text of its pages; what does not recur, at most that of its page.
MOST = 0.5
LOW_SHARE = 0.25
#: How many times the usual length makes a subtree that holds most of a page something else than furniture.
UNUSUAL = 4
#: Text within links, as a share, and number of links, that make a menu.
LINKED, LINKS = 0.8, 3

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
SILENT = RAW | frozenset("head select option object canvas audio video button label input".split())
NAMED = frozenset("nav footer aside form fieldset dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img br".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Class or id words that name page furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
                      "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets "
                      "header masthead topbar footer copyright cookie cookies consent gdpr notice notices notification "
                      "newsletter subscribe subscription signup login popup modal overlay alert disclaimer related "
                      "recommended recommendations share sharing social comment comments commentlist reply replies "
                      "respond disqus discussion form search skip toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)")
_WORD = re.compile(r"[a-z0-9]+")
#: A start tag of the key ends an open element of the value (optional end tags).
_ENDS_P = frozenset("address article aside blockquote body center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table article section div body main aside nav".split())


#: Kinds of hashes, in their lowest bits: tags and text, tags and class names, prose of an article.
TEXT, SHAPE, QUOTED = 0, 1, 2


class _Node:
    __slots__ = ("tag", "named", "names", "drop", "article", "parts", "key", "chars", "linked", "links", "tags")

    def __init__(self, tag, named, names, drop, article):
        self.tag, self.named, self.names, self.drop, self.article = tag, named, names, drop, article
        self.parts, self.key, self.chars, self.linked, self.links, self.tags = [], 0, 0, 0, 0, 0


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _named(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """2 when the markup names the element as furniture, 1 when a part of a compound class does, else 0."""
    if tag in ("html", "body", "main"):
        return 0
    if tag in NAMED or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or tag == "header" and not in_article:
        return 2
    if attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return 2
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    heading = tag in PROSE and tag[0] == "h"
    if FURNITURE.intersection(names.split()) - (frozenset(("header", "banner")) if heading else frozenset()):
        return 2
    return int(not heading and tag != "article" and bool(FURNITURE.intersection(_WORD.findall(names))))


def parse(page: str | None) -> tuple[list[tuple[str, list[int]]], int]:
    """Blocks of a page by itself, as (text, hashes of the subtrees around it), and a hash of the body."""
    blocks, seen, _, body = read(page)
    return [(text, [seen[i][0] for i in at]) for text, at, low in blocks if not low], body


def read(page: str | None) -> tuple[list[tuple[str, list[int], bool]], list[tuple[int, int]], int, int]:
    """Blocks of a page in order, as (text, places in the list of hashes, in small named furniture); the hashes of
    its subtrees with their letters; its letters; and a hash of the body."""
    page = page or ""
    root = _Node("", 0, "", False, False)
    stack, pos, raw = [root], 0, None
    for m in _TOKEN.finditer(page):
        if raw:                                        # inside script, style ...: only its own end tag counts
            if not (m[2] and m[1] and m[2].lower() == raw):
                continue
            raw, pos = None, m.start()
        if m.start() < pos:
            continue
        if m.start() > pos:
            stack[-1].parts.append(page[pos:m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not (tag in INLINE and any(stack[i].tag in _SCOPE for i in range(depth + 1, len(stack)))):
                del stack[depth:]
            elif tag == "p":
                stack[-1].parts.append(None)
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "wbr", "img", "input") else None)
            continue
        if tag in _ENDS_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in _SCOPE), 0)
            if depth and stack[depth].tag == "p":
                del stack[depth:]
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SIBLINGS[tag]:
                    del stack[i:]
                elif stack[i].tag in _SCOPE:
                    break
        above = stack[-1]
        drop = above.drop or tag in SILENT
        attrs = _attributes(m[3]) if m[3] and not drop else {}
        named = 0 if drop else _named(tag, attrs, above.article)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower()
        node = _Node(tag, named, names, drop, above.article or tag == "article" and named < 2)
        above.parts.append(node)
        if m[3].rstrip().endswith("/"):
            if tag in RAW:
                continue
        stack.append(node)
        if tag in RAW:
            raw = tag
    if pos < len(page) and not raw:
        rest = page[pos:]
        cut = rest.find("<")                           # a tag that the input cuts off
        stack[-1].parts.append(rest if cut < 0 or not re.match(r"</?[a-zA-Z!?]", rest[cut:]) else rest[:cut])
    _hash(root)
    small = list(_furniture(root, LOW_SHARE * root.chars))
    low = {id(x) for x in small} if sum(x.chars for x in small) <= MOST * root.chars else set()
    blocks: list[tuple[str, list[int], bool]] = []
    seen: list[tuple[int, int]] = []
    _collect(root, low, blocks, seen)
    return blocks, seen, root.chars, _body(root)


def _walk(root):
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            yield node
            todo.extend(x for x in node.parts if isinstance(x, _Node))


def _furniture(root, most):
    """Named furniture of at most so many letters that lies in no other."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.named == 2 and node.chars <= most:
            yield node
        elif not node.drop:
            todo.extend(x for x in node.parts if isinstance(x, _Node))


def _body(root) -> int:
    """Hash of the page without its named furniture, or of all of it when it is nothing else."""
    out = {id(x) for x in _furniture(root, MOST * root.chars)}
    h = blake2b(digest_size=8)
    todo, empty = [root], True
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            flat = " ".join(x.split())
            empty = empty and not flat
            h.update(b"t" + flat.encode("utf-8", "surrogatepass"))
        elif x is not None and not x.drop and id(x) not in out:
            h.update(b"n" + x.tag.encode("utf-8", "surrogatepass"))
            todo.extend(reversed(x.parts))
    return root.key if empty else int.from_bytes(h.digest(), "little", signed=True)


_CONTENT = sum({1 << crc32(t.encode()) % 61 for t in ("h1", "article", "main")})


def _hash(root) -> None:
    """Hashes and sizes of subtrees, children first, without recursion (documents can nest deeply)."""
    order = list(_walk(root))
    for node in reversed(order):
        h = blake2b(node.tag.encode(), digest_size=8)
        for x in node.parts:
            if isinstance(x, str):
                flat = " ".join(x.split())
                h.update(b"t" + flat.encode("utf-8", "surrogatepass"))
                node.chars += len(flat)
            elif x is not None and not x.drop:
                h.update(b"n%d" % x.key)
                node.chars += x.chars
                node.linked += x.chars if x.tag == "a" else x.linked
                node.links += x.links + (x.tag == "a")
                node.tags |= x.tags | 1 << crc32(x.tag.encode()) % 61
        node.key = int.from_bytes(h.digest(), "little", signed=True)


def _shape(node) -> int | None:
    """Hash of the tags and class names of named furniture or of a menu."""
    menu = node.links >= LINKS and node.linked >= LINKED * node.chars and not node.tags & _CONTENT
    weak = node.named == 1 and node.links and node.linked >= MOST * node.chars and not node.tags & _CONTENT
    if node.named < 2 and not menu and not weak:
        return None
    names = " ".join(sorted(set(re.sub(r"[0-9]+", "", node.names).split())))
    h = blake2b(f"{node.tag} {names} {node.tags}".encode("utf-8", "replace"), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def _collect(root, low, blocks, seen) -> None:
    """Blocks between the borders of block elements.  Inline furniture that is small goes at once."""
    text: list[str] = []
    held: tuple[list[int], bool] = [], False

    def flush(now):
        nonlocal held
        joined = " ".join(_html.unescape("".join(text)).split())
        text.clear()
        if joined:
            blocks.append((joined, *held))
        held = now

    def around_of(x, around):
        """Places of the hashes around the inside of ``x``."""
        at, small = around
        if x.chars and x.tag not in ("html", "body", "main", "article"):
            seen.append((x.key & ~3 | (QUOTED if x.article and x.tag in PROSE else TEXT), x.chars))
            at = at + [len(seen) - 1]
        shape = _shape(x) if x.chars else None
        if shape is not None:
            seen.append((shape & ~3 | SHAPE, x.chars))
            at = at + [len(seen) - 1]
        return at, small or id(x) in low

    # (node, index of the next part, places and smallness around it)
    todo = [(root, 0, held)]
    while todo:
        node, i, around = todo.pop()
        for j in range(i, len(node.parts)):
            x = node.parts[j]
            if x is None:
                flush(around)
            elif isinstance(x, str):
                if not text:
                    held = around
                text.append(x)
            elif x.drop or x.tag in INLINE and id(x) in low:
                if x.tag not in INLINE:
                    flush(around)
            else:
                todo.append((node, j + 1, around))
                below = around
                if x.tag not in INLINE:
                    below = around_of(x, around)
                    flush(below)
                todo.append((x, 0, below))
                break
        else:
            if node.tag not in INLINE:
                flush(around)
    flush(([], False))


_SEEN = pa.list_(pa.struct([("key", pa.int64()), ("part", pa.int32())]))
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("at", pa.list_(pa.int32())), ("low", pa.bool_())]))
_SCHEMA = ("page_id long, url string, host string, body long, chars long, seen array<struct<key:long,part:int>>, "
           "blocks array<struct<text:string,at:array<int>,low:boolean>>")


def _parsed(batches):
    for batch in batches:
        ids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
        hosts = [re.sub(r"^[a-z][a-z0-9+.-]*://", "", u.strip().lower()).split("/")[0].split("?")[0].split("#")[0]
                 if u else "" for u in urls]
        out = [read(p) for p in pages]
        blocks = [[{"text": t.encode("utf-8", "replace").decode(), "at": at, "low": low} for t, at, low in o[0]] for o in out]
        seen = [[{"key": k, "part": n} for k, n in o[1]] for o in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(hosts, pa.string()),
             pa.array([o[3] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
             pa.array(seen, _SEEN), pa.array(blocks, _BLOCKS)],
            ["page_id", "url", "host", "body", "chars", "seen", "blocks"])


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, key) of the subtrees that recur on many different pages of their host, with the number of these pages,
    of all subtrees with that key, and their usual length."""
    kind = F.col("key").bitwiseAND(3)
    bodies = (parsed.select("host", "body", "chars", F.explode("seen").alias("s")).select("host", "body", "chars", "s.key", "s.part")
              .withColumns({c: F.when(kind == SHAPE, F.col(c)) for c in ("part", "chars")})       # of no use for the others
              .groupBy("host", "key", "body")
              .agg(F.count("*").alias("held"), F.max("part").alias("part"), F.max("chars").alias("chars")))
    counts = stored(bodies.groupBy("host", "key").agg(F.count("*").alias("pages"), F.sum("held").alias("held"), F.avg("part").alias("usual"),
                                                      (F.sum("part") / F.sum("chars")).alias("share"))
                    .filter(F.col("pages") >= min_pages), "subtrees")
    hosts = parsed.groupBy("host").agg(F.countDistinct("body").alias("of"), F.sum(F.size("seen")).alias("entries"))
    bar = F.least(F.lit(float(MANY_PAGES)), F.col("of") * min_share)
    return (attach_groups(counts, hosts, "host", "entries", _entries(parsed))
            .filter(F.when(kind == QUOTED, F.col("pages") >= F.col("of") * ARTICLE_SHARE).otherwise(F.col("pages") >= bar))
            .filter((kind != SHAPE) | (F.col("share") <= MOST)).select("host", "key", "pages", "held", "usual"))


def _entries(parsed: DataFrame) -> int:
    return int(parsed.agg(F.sum(F.size("seen"))).first()[0] or 0)


def _places(often: dict[tuple[str, int], float]):
    """Column function host, chars, seen -> places of the subtrees in ``often``, which has their usual length."""
    def one(host, chars, seen):
        found = []
        for i, s in enumerate(seen):
            if (host, s["key"]) not in often:
                continue
            usual = often[host, s["key"]]
            if not (s["key"] & 3 == SHAPE and s["part"] > MOST * chars and s["part"] > UNUSUAL * usual):
                found.append(i)
        return found

    def run(hosts, chars, seen):
        return pa.array([one(*x) for x in zip(hosts.to_pylist(), chars.to_pylist(), seen.to_pylist())], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_template_blocks of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    parsed = stored(rows.mapInArrow(_parsed, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "pages", "zstd")
    found = stored(templates(parsed, min_pages, min_share), "templates")
    floor = hot_floor(_entries(parsed))
    often = {(r.host, r.key): r.usual for r in found.filter(F.col("held") >= floor).collect()}  # at most 1 / HOT_SHARE rows
    marked = parsed.withColumn("gone", _places(often)("host", "chars", "seen"))
    rest = F.filter("blocks", lambda b: ~F.arrays_overlap(b["at"], F.col("gone")))
    here = (marked.select("row", "host", "chars", "seen", F.explode(F.array_distinct(F.flatten(rest["at"]))).alias("place"))
            .withColumn("s", F.col("seen")[F.col("place")]).select("row", "host", "chars", "place", "s.key", "s.part"))
    main = (F.col("key").bitwiseAND(3) == SHAPE) & (F.col("part") > MOST * F.col("chars")) & (F.col("part") > UNUSUAL * F.col("usual"))
    hit = stored(here.join(found.filter(F.col("held") < floor), ["host", "key"]).filter(~main)
                 .groupBy("row").agg(F.collect_list("place").alias("seldom")), "hits")         # one page's own subtrees
    rows = marked.join(hit, "row", "left").withColumn("gone", F.concat("gone", F.coalesce("seldom", F.array().cast("array<int>"))))
    return (rows.withColumn("rest", rest).withColumn("left", F.filter("rest", lambda b: ~b["low"]))
            .select("page_id", "url", F.array_join(F.col("left.text"), " ").alias("text"),
                    F.size("blocks").alias("n_blocks"), (F.size("blocks") - F.size("rest")).alias("n_template_blocks"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_template_blocks"))


def op2_site_templates(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Operator 10, main text of web pages with site templates removed.

Pages are read by a tolerant scanner. Elements that by tag, role or class are menus, headers, footers, sidebars,
notices, adverts, forms or comments are left out. Of what remains, every block's subtree is hashed, inside and outside
of article and main elements (not these themselves); Spark counts on how many distinct pages of a host each hash
occurs, and subtrees that recur on many of them are deleted. A page with an article or main element gives what is left
of these; others give all that is left. Inside and outside are counted apart: what is a box around the articles can be
quoted in one. Inside, only boxes are hashed (div, section, list, table and the like): a heading or paragraph that
articles share, as near copies and license lines do, is their text and no part of a template.

Cases: null html is empty, and gives an empty text; pages with a null url, or one without "://", are of no host and have
no templates; pages of a host whose text is equal before the deletion count as one, so copies don't make their own text
a template; equal rows get equal results; an empty table gives an empty result; other columns pass through, but a
column named text is replaced. A page is held whole by a task and scanned in one pass, however it is nested or broken.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import replaced, with_columns, without
from .staging import staged
from .url_filters import host_path

#: A subtree is a template if at least so many distinct pages of its host have it, however many the host has.
LEAST_PAGES = 5

#: Templates up to this many, 8 bytes each, are broadcast; more are joined to the pages' subtrees by shuffle.
BROADCAST_TEMPLATES = 1_000_000

#: Elements left out whole, those whose content is no markup, and those without content.
LEFT_OUT = set("head nav header footer aside form script style noscript template iframe svg button select textarea title menu dialog object canvas".split())
RAW = "script|style|textarea|title|noscript|template|iframe|xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that begin and end a block of text.
BLOCKS = set("html address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())

#: Blocks of text; an article's own aren't templates, however many articles share them.
TEXT_BLOCKS = set("address blockquote caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre summary tbody td tfoot th thead tr".split())

#: Words of class, id and role that mark what isn't main text.
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar".split())

#: Words that say where or what kind of box a mark's is (share-bar, site-header); with any other word a
#: class tells something about the page or its article (no-sidebar, header-fixed, has-navigation, share-enabled).
PLACES = set("area bar block bottom box button buttons container content global inner left links list main outer page panel primary right row secondary section site top widget widgets wrap wrapper".split())

#: Words that mark whatever stands beside them (post-comments, related-posts), unless the class tells
#: something about a page (has-comments), and words in a row that do so together.
STRONG = set("comment comments commentlist respond disqus related relatedposts breadcrumb breadcrumbs newsletter advert adverts advertisement advertising sponsored sharedaddy".split())
ABOUT = set("no not has have is are with without can open opened closed enabled disabled on off hide hidden show count".split())
TOGETHER = ["widget area", "post meta", "entry meta", "article meta", "post tags", "post footer", "entry footer", "post navigation", "post nav", "author box", "author bio", "about author", "share buttons", "social share", "most read", "more stories", "read more", "read next", "see also", "also like", "skip link", "screen reader text", "back to top"]

#: Elements that are never left out for a mark, and those that an open head can hold.
UNMARKED = set("html body main article".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())

#: Fixed value: comments, raw elements, tags and declarations; a tag ends before the next one begins, so that each is read once.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*+>", re.S | re.I)
MARKED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


#: Fixed value: what isn't shown.
HIDDEN = re.compile(r"""^(?:[^"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))*?\shidden(?=[\s=/]|$)|\sstyle\s*=\s*["']?[^"'>]*?display\s*:\s*none""", re.I)


def _mark(attributes: str) -> int:
    """1 if a whole token of class, id or role is a mark, made of words of MARKS, and PLACES at most; 2 if one has a
    strong word, or words that mark together."""
    found = 0
    for m in MARKED.findall(attributes):
        for token in m.strip("\"'").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", token) if w]
            if not any(w in ABOUT for w in words):
                line = f" {' '.join(words)} "
                if any(w in STRONG for w in words) or any(f" {t} " in line for t in TOGETHER):
                    return 2
            if any(w in MARKS for w in words) and all(w in MARKS or w in PLACES or w.isdigit() for w in words):
                found = 1
    return found


def _left_out(tag: str, attributes: str) -> int:
    """0: stays; 1: left out, though an article in it would stay; 2: left out with all that is in it."""
    if tag in LEFT_OUT:
        return 2 if attributes and _mark(attributes) == 2 else 1
    if not attributes or tag in UNMARKED:
        return 0
    return 2 if HIDDEN.search(attributes) else _mark(attributes)


def _hash(text: str, key: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8, key=key).digest(), "big", signed=True)


def scan_page(page: str, is_template: Callable[[int], bool] | None = None, want_hashes: bool = False, host: str = "", firm: bool = True) -> tuple[str, set[int]]:
    """The page's text without what is left out and without templates; hashes of its subtrees that have text, with
    the host in each. firm: an article in a box of comments or the like isn't the page's; where that leaves no text, it is."""
    # Tag, and blocks, parts of the trail and articles before it, and whether what is around it is left out or in an article.
    stack: list[tuple[str, int, int, int, int, bool]] = []
    opened: Counter[str] = Counter()
    # What has been read, with the digest of each closed block in place of its content.
    trail: list[str] = []
    hashing = want_hashes or is_template is not None
    blocks: list[tuple[str, bool]] = []
    words: list[str] = []
    hashes: set[int] = set()
    articles, passed = 0, False
    out, own = 0, False

    def read(text: str) -> None:
        words.append(text)
        if hashing and (plain := " ".join(text.split())):
            trail.append(plain)

    def flush() -> None:
        if words:
            text = " ".join(references.unescape("".join(words)).split())
            words.clear()
            if text:
                blocks.append((text, own))

    def close() -> None:
        nonlocal out, own
        tag, n_blocks, start, before, was_out, was_own = stack.pop()
        opened[tag] -= 1
        if tag in BLOCKS:
            flush()
            if hashing and not out:
                whole = "\0".join(trail[start:])
                del trail[start:]
                h = _hash(whole)
                trail.append(f"{h:x}")
                if len(blocks) > n_blocks and tag not in UNMARKED and (tag not in TEXT_BLOCKS if own else articles == before):
                    h = _hash(f"{host}\0{h:x}", b"own" if own else b"")
                    if want_hashes:
                        hashes.add(h)
                    if is_template and is_template(h):
                        del blocks[n_blocks:]
        elif hashing and not out:
            trail.append("/" + tag)
        out, own = was_out, was_own

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not out:
            read(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in BLOCKS and not out:
            flush()
        elif tag == "br" and not out:
            words.append(" ")
        if tag in VOID:
            if hashing and not out:
                trail.append(" ".join(m[0].split()))
            continue
        if tag == "body" and opened["head"] > 0:
            while opened["head"] > 0:
                close()
        elif tag not in IN_HEAD and stack and stack[-1][0] == "head":
            # A head's end tag is optional.
            close()
        if tag == "p" and stack and stack[-1][0] == "p":
            close()
        main = tag in ("article", "main")
        if main and out and not own and not _mark(m[4]):
            # An article isn't part of a menu that was left open, if it isn't a comment or the like itself, or in a box of these.
            passed = passed or out == 2
            while out and not (firm and out == 2):
                close()
        leaves = max(out, _left_out(tag, m[4])) if out < 2 else out
        stack.append((tag, len(blocks), len(trail), articles, out, own))
        opened[tag] += 1
        if hashing and not leaves:
            trail.append(" ".join(m[0].split()))
        if main and not leaves:
            articles += 1
        out, own = leaves, own or (main and not leaves)
    if at < len(page) and not out:
        read(page[at:])
    while stack:
        close()
    flush()
    text = "\n".join(t for t, o in blocks if o or not articles)
    return (text, hashes) if text or not (firm and passed) else scan_page(page, is_template, want_hashes, host, False)


TEXT = {"text": "string"}


def _columns(batch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _subtrees(batches):
    for batch in batches:
        texts, subtrees = [], []
        for host, page in _columns(batch, "_host", "html"):
            if not host:
                continue
            text, hashes = scan_page(page or "", want_hashes=True, host=host)
            subtrees += hashes
            texts += [_hash(text)] * len(hashes)
        yield pa.record_batch([pa.array(texts, pa.int64()), pa.array(subtrees, pa.int64())], names=["text", "subtree"])


def templates(hosted: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """subtree: the hashes, host included, of those that recur on many of their host's distinct pages; a row for each."""
    found = hosted.select("_host", "html").mapInArrow(_subtrees, "text long, subtree long")
    return found.distinct().groupBy("subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("subtree")


def _of_pages(batches):
    """The subtrees of each page, by the page's key."""
    for batch in batches:
        keys, subtrees = [], []
        for key, host, page in _columns(batch, "_page", "_host", "html"):
            hashes = scan_page(page or "", want_hashes=True, host=host)[1] if host else ()
            subtrees += hashes
            keys += [key] * len(hashes)
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array(subtrees, pa.int64())], names=["_page", "subtree"])


def _with_text(batch, tests):
    return replaced(batch, {"text": pa.array([scan_page(page or "", test if host else None, host=host)[0] for (host, page), test in zip(_columns(batch, "_host", "html"), tests)], pa.string())})


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages (url, html and others) with text added."""
    pages = without(pages, TEXT, "html", "url")
    hosted = pages.withColumn("_host", host_path(F.col("url"))[0])
    known = staged(templates(hosted, least_pages), "templates")
    # Templates are counted; few are sent to all tasks, so that no page moves.
    if known.count() <= BROADCAST_TEMPLATES:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["subtree"].to_numpy()))

        def one(batches):
            # In order, and searched, as a set of so many would take several times the bytes.
            every = sent.value

            def test(h: int) -> bool:
                at = every.searchsorted(h)
                return bool(at < len(every) and every[at] == h)

            for batch in batches:
                yield _with_text(batch, [test if len(every) else None] * len(batch))

        return hosted.mapInArrow(one, with_columns(hosted, TEXT)).drop("_host")

    keyed = hosted.withColumn("_page", F.sha2(F.concat_ws("\0", "_host", "html"), 256))
    # Copies have one key and one set of subtrees.
    of_pages = keyed.select("_page", "_host", "html").mapInArrow(_of_pages, "_page string, subtree long").distinct()
    by_page = of_pages.join(known, "subtree").groupBy("_page").agg(F.collect_list("subtree").alias("_templates"))
    joined = keyed.join(by_page, "_page", "left")

    def joint(batches):
        for batch in batches:
            yield _with_text(batch, [frozenset(t).__contains__ if t else None for t, in _columns(batch, "_templates")])

    return joined.mapInArrow(joint, with_columns(joined, TEXT)).select(*pages.columns, "text")

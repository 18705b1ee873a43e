"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template.  A page is read as tokens: its elements,
named by their path of structural elements (``body/div.ad``), and its text
blocks, named by path and text.  For each host and token the pages' occurrence
counts make a vector; tokens of one vector form an equivalence class.  Classes
that are frequent (on at least ``SUPPORT`` of the host's pages) and nest (each
lies wholly inside or outside the slots of the others, which for paths means
that their elements hold one another) make up the template.  A frequent text
block is part of the template itself if it has the vector of such a class, or
is on ``NEARLY`` all pages that have its element, so pages of another kind or
a few without the block do not matter; blocks that only exact copies of one
page share are not.  What is left are the slots.

Slots inside elements that are boilerplate by their name (``nav``, ``footer``,
``aside``, a class such as ``cookie`` or ``comments``) are dropped, but an
element that holds ``MAIN_SHARE`` of the slots' text of the host's pages is
taken whatever its name, so no element round the main text is dropped for its
name.  Where a host's pages have no main element of their own in common (or a
page does not have it), an element that holds so much of the page's text and
has other words in its names as well is taken too.  The main text is under the deepest template element that holds most of
the text of the remaining slots; its blocks, less the template's own, are the
page's text.  Digits in names count as one, as numbered names differ by page.

Occurrence vectors are never built: a vector is known by two sums over the
host's pages of hashes of (page, count), so they are plain aggregates with
partial sums before the shuffle, however many pages a host has.  Templates are
small (frequent tokens only) and are joined to the pages by host.

Defined results: a page is read whole, one at a time, whatever its length, in
linear time; of elements that hold equal text the deepest is taken, then the
last by name; a null or empty html, or one without a text block, gives an
empty text; a null url belongs to the host ``""``; hosts of fewer than
``LEAST_PAGES`` pages have no template text, only elements; repeated rows are
pages of their own; an empty table gives no rows; columns other than
``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import saved, text_list
from evalframe.llm.word_cache import no_cycle_collection

# A class is frequent on this share of a host's pages; text blocks become
# template only on hosts of so many pages.
SUPPORT, LEAST_PAGES = 0.5, 5
# A template's text block is on this share of the pages that have its element.
NEARLY = 0.8
# The element of the main text holds this share of the slots' text.
MAIN_SHARE = 0.6
# Templates of so many bytes in all are broadcast; larger ones are joined by host.
BROADCAST_BYTES = 16 << 20

# ------------------------------------------------- fixed values: HTML element names
INVISIBLE = "script style noscript template textarea select button svg math canvas iframe object video audio title".split()
INLINE = """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span
strike strong sub sup time tt u var wbr""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE_ELEMENTS = "head nav header footer aside form menu dialog".split()
BOILERPLATE_WORDS = """ad ads advert advertisement banner sponsor sponsored promo promotion cookie cookies consent notice
alert popup modal overlay newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs header footer masthead
sidebar aside widget related recommended share sharing social comment comments reply replies respond discussion login
search pagination pager tags copyright legal disclaimer""".split()

# elements of a text; the main text is inside another one
TEXT_ELEMENTS = "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre hr".split()

# The rest of a tag, taken without second thoughts: a value is quoted only after
# "=", and outside quotes a "<" ends the attempt, so a tag that is never closed
# is read as far as the next one and a page is scanned in linear time.
_REST_OF_TAG = r"(?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>" + "|".join(INVISIBLE) + r")\b" + _REST_OF_TAG + r">.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<rest>" + _REST_OF_TAG + r")>"
    r"|<[a-zA-Z/!?][^<>]*+(?:>|\Z|(?=<))", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_CUT, _DIGITS = re.compile(r"[^a-z]+"), re.compile(r"\d+")
_INLINE, _VOID = frozenset(INLINE), frozenset(VOID)
_BOILERPLATE = frozenset(BOILERPLATE_ELEMENTS)
_BOILERPLATE_WORDS = frozenset(BOILERPLATE_WORDS)
# An open paragraph, list item, cell or the like ends where such an element begins.
_ENDS_WHERE = {"p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
               "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"],
               "option": ["option"]}


def _is_boilerplate(element: str) -> bool:
    """``element``: the last part of a path."""
    name, _, names = element.partition(".")
    return name in _BOILERPLATE or (names != "" and name not in ("html", "body") and not _BOILERPLATE_WORDS.isdisjoint(_CUT.split(names)))


def blocks(source: str, kept: frozenset[str] = frozenset()) -> Iterator[tuple[str, bool, str]]:
    """(path, whether it is inside boilerplate, text) of every text block, in
    page order; elements without text give a block of no text.  ``kept``:
    paths of elements that are no boilerplate whatever their name."""
    stack: list[tuple[str, str, bool]] = []  # element, path, boilerplate
    path, inside, parts = "", False, []
    last = 0

    def ended() -> tuple[str, bool, str]:
        text = " ".join(html_module.unescape("".join(parts)).split())
        parts.clear()
        return path, inside, text

    for m in _MARKUP.finditer(source):
        if m.start() > last:
            parts.append(source[last:m.start()])
        last = m.end()
        name = m.group("name")
        if name is None:
            continue  # comments, scripts and the like, broken markup
        name = name.lower()
        if name in _INLINE:
            continue
        if parts:
            yield ended()
        if name in _VOID:
            continue
        if m.group("close"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            while stack and name in _ENDS_WHERE.get(stack[-1][0], ()):
                stack.pop()
            attributes = m.group("rest")
            path, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            names = ".".join(sorted({w for found in _NAMES.findall(attributes) for w in "".join(found).lower().split()})) if attributes else ""
            names = _DIGITS.sub("0", names)  # numbered names differ by page
            element = f"{name}.{names}".replace("/", "|") if names else name
            path = f"{path}/{element}"
            stack.append((name, path, inside or (_is_boilerplate(element) and path not in kept)))
            yield path, stack[-1][2], ""
        path, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
    if last < len(source):
        parts.append(source[last:])
    if parts:
        yield ended()


def _short(text: str) -> int:
    """63-bit hash: a token's name in a template."""
    return xxhash.xxh64_intdigest(text) >> 1


# --------------------------------------------------------------- page tokens

_TOKENS = "host string, page long, kind int, token long, path string, named boolean, n long, chars long, content long"
# Levels of the path of a rare element that are told apart, and the rest.
LEVELS, _REST = 5, "/*"


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per page and token: ``kind`` 0 for an element, 1 for a text
    block of the element ``path``; ``named``, whether an element beyond
    ``LEVELS`` is boilerplate by name; ``n`` occurrences, ``chars`` of text of
    the block or directly in the element; ``content``, the same for copies of
    a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_collection():
            for b in batches:
                rows = []
                for host, page, source in zip(text_list(b.column(0)), b.column(1).to_pylist(), text_list(b.column(2))):
                    elements, chars, texts, content = Counter(), Counter(), Counter(), _short(source)
                    for path, _, text in blocks(source):
                        if text:
                            texts[path, text] += 1
                            chars[path] += len(text)
                        else:
                            elements[path] += 1
                    for path in {*elements, *chars}:
                        rows.append((host, page, 0, _short(path), path, any(map(_is_boilerplate, path.split("/")[LEVELS + 1:])), elements[path] or 1, chars[path], content))
                    for (path, text), n in texts.items():
                        rows.append((host, page, 1, _short(f"{path}\0{text}"), path, False, n, n * len(text), content))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = [f.split()[0] for f in _TOKENS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pages.select("host", F.monotonically_increasing_id().alias("page"), "html").mapInArrow(run, _TOKENS)


# ------------------------------------------------------------------ templates

def _under(chars: dict[str, int]) -> dict[str, int]:
    """Text under each path: of the element and of all inside it."""
    under: dict[str, int] = defaultdict(int)
    for path, n in chars.items():
        for p in (path, *_ancestors(path)):
            under[p] += n
    return under


def _kept(chars: dict[str, int]) -> frozenset[str]:
    """Elements that are boilerplate by name, but hold most of the text."""
    under = _under(chars)
    total = sum(v for p, v in under.items() if p.count("/") == 1)
    return frozenset(p for p, v in under.items() if total and v >= MAIN_SHARE * total
                     and _REST not in p and _is_boilerplate(p.rpartition("/")[2]))


def _inside(path: str, kept: frozenset[str]) -> bool:
    return any(p not in kept and _is_boilerplate(p.rpartition("/")[2]) for p in (path, *_ancestors(path)))


def _template(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's frequent tokens -> the path of its main text, its own texts,
    the elements that are no boilerplate whatever their name."""
    host = pdf["host"].iat[0]
    pages = int(pdf["n_pages"].iat[0])
    elements = pdf[pdf["kind"] == 0]
    # classes of elements that share an occurrence vector; those on enough pages nest in the template
    frequent = {p for p, s in zip(elements["path"], elements["support"]) if s >= SUPPORT * pages}
    classes = Counter(zip(elements["s0"], elements["s1"]))
    ones = [p for p, s, n, a, b in zip(elements["path"], elements["support"], elements["total"], elements["s0"], elements["s1"])
            if p in frequent and (n == s or classes[a, b] > 1)]
    valid = [p for p in ones if all(q in frequent for q in _ancestors(p))]
    nested = set(valid)
    # a frequent text block is the template's own if it has a class, or is on nearly all pages that have its element
    texts = pdf[(pdf["kind"] == 1) & (pdf["support"] >= SUPPORT * pages) & (pages >= LEAST_PAGES) & ~pdf["copies"]]
    support = dict(zip(elements["path"], elements["support"]))
    vectors = {(a, b) for p, a, b in zip(elements["path"], elements["s0"], elements["s1"]) if p in nested}
    texts = texts[np.array([(a, b) in vectors or s >= NEARLY * support.get(p, pages)
                            for p, s, a, b in zip(texts["path"], texts["support"], texts["s0"], texts["s1"])], dtype=bool)]
    # the slots' text of each element: all but the template's own
    chars = Counter({p: int(n) for p, n in zip(elements["path"], elements["chars"])})
    chars.subtract(Counter(dict(texts.groupby("path")["chars"].sum().astype(int))))
    kept = _kept(chars)
    under = _under({p: n for p, n in chars.items() if not _inside(p, kept)})
    total = sum(v for p, v in under.items() if p.count("/") == 1)
    once = {p for p, s, n in zip(elements["path"], elements["support"], elements["total"]) if n == s}
    holding = [p for p in valid if total and under[p] >= MAIN_SHARE * total and p in once
               and p.rpartition("/")[2].partition(".")[0] not in TEXT_ELEMENTS]
    main = max(holding, key=lambda p: (p.count("/"), under[p], p), default="")
    return pd.DataFrame({"host": [host], "main": [main], "own": [texts["token"].tolist()], "kept": [sorted(kept)]})


def _ancestors(path: str) -> list[str]:
    out = []
    path = path.rpartition("/")[0]
    while path:
        out.append(path)
        path = path.rpartition("/")[0]
    return out


def templates(tokens: DataFrame) -> DataFrame:
    """``host``, ``main`` (path of the element of the main text), ``own``
    (names of text blocks that are the template's), ``kept`` (elements that
    are no boilerplate whatever their name).  ``tokens`` are saved."""
    h = F.xxhash64("page", "n")
    # two sums of 31-bit hashes: they overflow at no less than 2^32 pages
    # a token has one path: strings as keys, not as first values, spare a sort
    vectors = tokens.groupBy("host", "kind", "token", "path", "named").agg(
        F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"), (F.min("content") == F.max("content")).alias("copies"),
        F.sum("chars").alias("chars"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("s0"),
        F.sum(F.shiftrightunsigned(h, 33)).alias("s1"))
    pages = tokens.where("kind = 0").groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("n_pages"))
    # rare elements are counted with the element that holds them, those inside boilerplate apart: a host's rows stay few
    rows = (vectors.join(pages.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host")).drop("_host")
            .where((F.col("support") >= F.lit(SUPPORT) * F.col("n_pages")) | ((F.col("kind") == 0) & (F.col("chars") > 0)))
            .withColumn("path", F.when((F.col("kind") == 0) & (F.col("support") < F.lit(SUPPORT) * F.col("n_pages")),
                                       F.concat(F.substring_index("path", "/", LEVELS + 1), F.when(F.col("named"), f"{_REST}/aside").otherwise(_REST))).otherwise(F.col("path"))))
    rows = rows.groupBy("host", "kind", "path", F.when(F.col("kind") == 1, F.col("token")).otherwise(F.lit(0)).alias("token")).agg(
        F.max("support").alias("support"), F.max("total").alias("total"), F.min("copies").alias("copies"),
        F.sum("chars").alias("chars"), F.max("s0").alias("s0"), F.max("s1").alias("s1"), F.max("n_pages").alias("n_pages"))
    return rows.groupBy("host").applyInPandas(_template, "host string, main string, own array<long>, kept array<string>")


# ------------------------------------------------------------------ extraction

def _mixed(element: str) -> bool:
    """Boilerplate by name, but with other words in its names as well."""
    words = {w for w in _CUT.split(element.partition(".")[2]) if w}
    return element.partition(".")[0] not in _BOILERPLATE and not words <= _BOILERPLATE_WORDS


def main_text(source: str, main: str, own: frozenset[int], kept: frozenset[str]) -> str:
    slots = [(path, text) for path, _, text in blocks(source) if text and _short(f"{path}\0{text}") not in own]
    below = [(path, text) for path, text in slots if main == "" or path == main or path.startswith(main + "/")]
    found = bool(below) or any(path == main or path.startswith(main + "/") for path, _, _ in blocks(source))
    if not found or main.count("/") <= 2:  # no element of the host's pages: what holds most of this page
        chars = Counter()
        for path, text in slots:
            chars[path] += len(text)
        page_kept = _kept(chars)
        if not found:
            kept |= page_kept
            below = slots
        else:
            kept |= {p for p in page_kept if _mixed(p.rpartition("/")[2])}
    return " ".join(text for path, text in below if not _inside(path, kept))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    # userinfo and port do not part hosts
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = saved(templates(saved(page_tokens(pages), "page-tokens")), "templates")
    size = found.agg(F.sum(F.length("host") + F.length("main") + 8 * F.size("own") + F.length(F.concat_ws(" ", "kept")) + 64).alias("n")).first()["n"] or 0
    found = found.select(F.col("host").alias("_host"), "main", "own", "kept")
    joined = pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("host") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_collection():
            for b in batches:
                texts = [main_text(source, main, frozenset(own or ()), frozenset(kept or ())) for source, main, own, kept in
                         zip(text_list(b.column(2)), text_list(b.column(3)), b.column(4).to_pylist(), b.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main", "own", "kept").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages: page structure, and a suffix array for each host over what structure leaves open.

A page is read as a stream of tags and text. Text in an <article> (or <main>, or an element of that role) is the page's
declared main text. Elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments by their tag, role, class or id are declared boilerplate; within the main text a class or id declares it
only if a whole name does (cookie-notice, but not related-work), else it leaves the element open. What is left, text
outside both, is open, on pages with and without a main text.

For the open text, the token streams of a host's pages outside their main text, each over all blocks of its page, are
taken together, and a suffix array
cut at REPEAT tokens is made of them: every suffix is keyed by host and its first REPEAT tokens, so suffixes that share
them meet in one group, and a group with two different pages is a substring that repeats. The maximal repeats are unions
of such windows, so a token is covered by a repeat of REPEAT or more tokens just if one of its windows repeats. An open
block that is covered whole goes, so a run of short blocks does; of other open blocks, tokens that repeats within the
block cover go, and unique runs stay. Groups are aggregated to two page keys before the shuffle, however
hot a host; equal pages count once, so copies of a page don't make its text boilerplate.

The declared main text is not cut by repeats: articles hold passages that other articles of the host hold too, and whole
copies of pages, and the result asked for is the whole article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import fresh, schema_plus, stored
from siltbed.llm.urlfilter import host_and_path

#: Tokens from which a repeated substring is boilerplate.
REPEAT = 5
#: Quotes count after = only. Possessive, so that a match never goes back; where one fails, the page's rest is read by _LENIENT.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)(>?)", re.S)
_LENIENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"']++)))?")
#: Elements whose content is not markup; they end at their own end tag only.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of their own that don't end a block either.
UNSEEN = (VOID | {"script", "style"}) - {"br", "hr"}
#: Elements whose end tags may be left out where the next one begins.
IMPLIED = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})
MAIN = frozenset({"article", "main"})
#: Boilerplate by tag. A header or footer within the main text counts too.
DROPPED = frozenset("nav header footer aside form script style head title template noscript iframe object svg button select option textarea input dialog menu audio video noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words in a class, an id or a role that declare boilerplate.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo "
    "promoted recommended recommendations related search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "trending widget complementary contentinfo disqus respond".split()
)
#: Elements that hold the page, and beginnings of names that tell of what is around: neither is boilerplate by its names.
HOLDERS = frozenset({"html", "body", "article", "main"})
AROUND = frozenset({"has", "with", "without", "no"})
#: Their ids are targets of links, not names of what they are.
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _declared(tag: str, attributes: str, within: bool) -> str:
    """main, dropped, open, or (within main text) doubtful: what an element's own tag says."""
    if tag in DROPPED:
        return "dropped"
    if attributes:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if found.get("role", "").lower() in ("main", "article"):
            return "main"
        kinds = ("class", "role") if within and tag in HEADINGS else ("class", "id", "role")
        named = [[x for x in re.split(r"[^a-z]+", w) if x] or [""] for k in kinds for w in found.get(k, "").lower().split()]
        names = {w for parts in named if parts[0] not in AROUND for w in parts}
        comment = tag == "article" and names & {"comment", "comments"}
        whole = not within or any(parts[0] not in AROUND and DROPPED_NAMES.issuperset(parts) for parts in named)
        by_name = names & DROPPED_NAMES and tag not in HOLDERS
        if comment or (by_name and whole) or HIDDEN.search(found.get("style", "")) or "hidden" in found:
            return "dropped"
        if by_name:
            return "doubtful"
    return "main" if tag in MAIN else "open"


def _inside(says: str, state: str) -> str:
    """What holds inside an element in a place of some state."""
    return next((s for s in ("dropped", "doubtful", "main") if s in (says, state)), "open")


def parse(page: str | None) -> tuple[str, list[tuple[str, bool]]]:
    """The declared main text, and the blocks outside it: (text, whether they are declared boilerplate), in page order."""
    found = blocks_of(page)
    return " ".join(t for t, s in found if s == "main"), [(t, s == "dropped") for t, s in found if s != "main"]


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """The blocks of a page in its order: (text, main, dropped or open). The time is linear in the page's length."""
    found: list[tuple[str, str]] = []
    block: list[str] = []
    # open elements, with what holds inside them, and the place of the nearest element around that is not inline
    stack: list[tuple[str, str, int]] = []
    count: Counter[str] = Counter()
    state, at, page, token = "open", 0, page or "", _TOKEN

    def close() -> None:
        text = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if text:
            found.append((text, "open" if state == "doubtful" else state))

    def leave(k: int) -> str:
        for tag, *_ in stack[k:]:
            count[tag] -= 1
        del stack[k:]
        return stack[-1][1] if stack else "open"

    end = len(page)
    while at < end:
        m = token.search(page, at)
        if m and m[2] and not m[4]:  # a tag without an end, or with a quote that nothing closes
            if token is _TOKEN:
                token = _LENIENT
                m = token.search(page, at)
            if not m[4]:
                block.append(page[at : m.start()])
                break
        start = m.start() if m else end
        if start > at:
            block.append(page[at:start])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if count[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if tag not in INLINE or stack[k][1] != (stack[k - 1][1] if k else "open"):
                    close()
                state = leave(k)
            elif tag not in INLINE:
                close()
            continue
        if tag in RAW:
            if tag not in UNSEEN:
                close()
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in UNSEEN:
            continue
        says = _declared(tag, m[3], state in ("main", "doubtful"))
        inside = _inside(says, state)
        if tag not in INLINE or inside != state:
            close()
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in IMPLIED and stack and stack[-1][2] >= 0 and stack[stack[-1][2]][0] == tag:
            inside = _inside(says, leave(stack[-1][2]))
        around = stack[-1][2] if stack else -1
        stack.append((tag, inside, around if tag in INLINE else len(stack)))
        count[tag] += 1
        state = inside
    close()
    return found


def undecided(found: list[tuple[str, str]]) -> bool:
    """Whether repeats on the host decide over blocks of a page: over the open ones."""
    return any(s == "open" for _, s in found)


def outside(found: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """The tokens of the blocks outside the main text, and the number of each token's block."""
    tokens: list[str] = []
    numbers: list[int] = []
    for i, (text, state) in enumerate(found):
        if state != "main":
            own = text.split()
            tokens += own
            numbers += [i] * len(own)
    return tokens, numbers


def windows(tokens: list[str], host: str) -> np.ndarray:
    """Keys of the first REPEAT tokens of each suffix that has so many."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest("\0".join([host, *tokens[k : k + REPEAT]])) for k in range(len(tokens) - REPEAT + 1)], np.uint64).view(np.int64)


def page_key(page: str | None) -> int:
    """Equal pages are one page."""
    return int(np.uint64(xxhash.xxh64_intdigest((page or "").encode("utf-8", "replace"))).view(np.int64))


STATES = ("main", "open", "dropped")


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for r in rows for x in r], kind))


def _zipped(texts: list[str], states: list[int]) -> list[tuple[str, str]]:
    return [(t, STATES[s]) for t, s in zip(texts, states)]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, page, open): window keys of the tokens outside the main text, open if one can be result."""
    for batch in batches:
        keys: list[int] = []
        owners: list[int] = []
        opens: list[bool] = []
        for host, own, texts, states in zip(*(c.to_pylist() for c in batch.columns)):
            blocks = _zipped(texts, states)
            found: dict[int, bool] = {}
            tokens, numbers = outside(blocks)
            todo = undecided(blocks)
            for at, k in enumerate(windows(tokens, host).tolist()):
                found[k] = found.get(k, False) or (todo and any(blocks[i][1] == "open" for i in numbers[at : at + REPEAT]))
            keys += found
            owners += [own] * len(found)
            opens += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.int64()), pa.array(opens, pa.bool_())], ["k", "page", "open"])


def decided(blocks: list[tuple[str, str]], host: str, repeats: frozenset[int]) -> str:
    """The main and open blocks of a page, without open blocks that repeated windows cover whole, and without the tokens of
    other open blocks that such windows within the block cover."""
    tokens, numbers = outside(blocks)
    covered, within = [False] * len(tokens), [False] * len(tokens)
    for at, k in enumerate(windows(tokens, host).tolist()):
        if k in repeats:
            covered[at : at + REPEAT] = [True] * REPEAT
            if numbers[at] == numbers[at + REPEAT - 1]:
                within[at : at + REPEAT] = [True] * REPEAT
    left: dict[int, list[str]] = {}
    stays = {i for i, c in zip(numbers, covered) if not c}
    for token, i, w in zip(tokens, numbers, within):
        if i in stays and not w:
            left.setdefault(i, []).append(token)
    return " ".join(filter(None, (t if s == "main" else " ".join(left.get(i, ())) if s == "open" else "" for i, (t, s) in enumerate(blocks))))


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars (code points).

    The text is the declared main text and the open blocks without tokens that repeat on other pages of the host. A null or empty html gives an empty text; a null url is a host of its own, the empty one.
    Character references are decoded, white space within a block becomes one space, and blocks join in page order by one
    space. Pages of any length are read whole, once: the blocks are stored, and the array is made of them if a page of the
    table has open text. Each row gives one row; repeated rows give equal rows; an empty table gives none; clashing names
    get a leading _, and columns of any name pass.
    """
    text, n = fresh(pages, "text"), fresh(pages, "n_chars")
    host, own, texts, states, got, of = (fresh(pages, c) for c in ("host", "page_key", "blocks", "states", "repeats", "of"))
    rows = pages.withColumns({"html": F.col("html").cast("string"), host: host_and_path(F.col("url").cast("string"))[0]})
    at = rows.columns.index("html")
    keep = [i for i in range(len(rows.columns)) if i != at]
    schema = schema_plus(rows, {own: "long", texts: "array<string>", states: "array<tinyint>"}, without=("html",))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html_of = batch.column(at).to_pylist()
            found = [blocks_of(page) for page in html_of]
            new = [pa.array([page_key(p) for p in html_of], pa.int64()), _lists([[t for t, _ in f] for f in found], pa.string()), _lists([[STATES.index(s) for _, s in f] for f in found], pa.int8())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=schema.names)

    blocks = stored(rows.mapInArrow(parsed, schema), "blocks")
    main = F.array_join(F.filter(F.col(texts), lambda t, i: F.get(F.col(states), i) == 0), " ")
    todo = F.array_contains(states, F.lit(STATES.index("open")).cast("tinyint"))
    others = [c for c in pages.columns if c != "html"]
    if not blocks.where(todo).take(1):  # no page has open text
        return blocks.select(*others, main.alias(text)).withColumn(n, F.length(text).cast("long"))
    streams = blocks.select(host, own, texts, states).mapInArrow(_streams, "k long, page long, open boolean")
    streams = stored(streams, "suffixes")
    repeated = streams.groupBy("k").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("k")
    covered = streams.where("open").join(repeated, "k").groupBy(F.col("page").alias(of)).agg(F.collect_set("k").alias(got))
    rest = blocks.where(todo).join(covered, F.col(own) == F.col(of), "left").drop(own, of)
    places = [rest.columns.index(c) for c in (host, texts, states, got)]
    last = [i for i, c in enumerate(rest.columns) if c not in (host, texts, states, got)]
    done = schema_plus(rest, {text: "string"}, without=(host, texts, states, got))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decided(_zipped(t, s), h, frozenset(repeats or ())) for h, t, s, repeats in zip(*(batch.column(i).to_pylist() for i in places))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in last), pa.array(made, pa.string())], names=done.names)

    filled = rest.mapInArrow(judged, done).select(*others, text)
    return blocks.where(~todo).select(*others, main.alias(text)).unionByName(filled).withColumn(n, F.length(text).cast("long"))

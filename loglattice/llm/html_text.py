"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the paragraphs in them, without links and boilerplate.  Every page
votes for its containers under a generalised path of block tags and classes; Spark adds the votes up per host, takes the
path with the most, and climbs from it to the lowest container, up to main or body, that holds all paragraph text there.
Pages are then read again and the text of what stands under their host's winning path is taken; a page where nothing
does falls back to its own best container, then to its body.

A path is known by a chained 64-bit hash of its labels, so a page is read in time and memory linear in its length,
however deep or broken its markup.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm._store import stored

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
_DROPPED = frozenset("nav header footer aside form menu dialog button select label fieldset".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td dd dt figcaption".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|notification|overlay|pagination|pager|popup|promo\w*|related|reply|replies|share|sharing|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_WHITE = re.compile(r"\s+")
_UNNAMED = frozenset("html body article main".split())  # never noise by their names
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_DIGITS = re.compile(r"\d+")


class _Container:
    """An open block element: its path's key, the key of its main or topmost element, and what it holds so far."""

    __slots__ = ("depth", "held", "key", "label", "scope", "score", "tag")

    def __init__(self, tag: str, label: str, above: _Container | None):
        self.tag, self.label, self.score, self.held = tag, label, 0.0, 0
        self.depth = above.depth + 1 if above else 0
        self.key = _key(above.key, label) if above else 0
        top = above is None or above.depth == 0 or (above.depth == 1 and above.tag == "html")
        self.scope = self.key if top or tag == "main" else above.scope


_keys: dict[tuple[int, str], int] = {}


def _key(above: int, label: str) -> int:
    known = _keys.get((above, label))
    if known is None:
        if len(_keys) > 100_000:
            _keys.clear()
        known = int.from_bytes(hashlib.blake2b(f"{above}>{label}".encode(errors="replace"), digest_size=8).digest(), "little", signed=True)
        _keys[above, label] = known
    return known


def _attributes(raw: str) -> tuple[str, str]:
    """Generalised classes, and everything that names the element."""
    classes, names = "", []
    for m in _CLASS.finditer(raw):
        value = html.unescape(m[2] or m[3] or m[4] or "")
        names.append(value)
        if m[1].lower() == "class":
            classes = ".".join(sorted(_DIGITS.sub("#", c) for c in value.split()))
    return classes, " ".join(names)


def _tag_end(page: str, at: int) -> int:
    """Place behind the tag's ``>``, quoted values passed over; a quote that does not close a value ends at the next ``>``."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return -1
        at, sign = stop.end(), stop[0]
        if sign == ">":
            return at
        before = at - 2
        while before >= 0 and page[before].isspace():
            before -= 1
        if page[before] != "=":
            continue
        close = page.find(sign, at)
        if close < 0 or not (close + 1 == len(page) or page[close + 1] in "/>" or page[close + 1].isspace()):
            return page.find(">", at) + 1 or -1
        at = close + 1


def _events(page: str):
    """('text', text, '') | ('open', tag, attributes) | ('close', tag, ''), raw elements' content left out.

    A tag, comment or declaration that the page's end cuts off ends the page.
    """
    start = at = 0  # of the text not yet given, and of the search
    endless: set[str] = set()  # raw elements that nothing behind closes
    while True:
        at = page.find("<", at)
        tag = _TAG.match(page, at) if at >= 0 else None
        if at >= 0 and tag is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1  # a less-than sign of the text
            continue
        stop = len(page) if at < 0 else at
        if stop > start:
            yield "text", page[start:stop], ""
        if at < 0:
            return
        if tag is None:
            end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            if end < 3:
                return
        else:
            end = _tag_end(page, tag.end())
            if end < 0:
                return
            name, raw = tag[2].lower(), page[tag.end() : end - 1]
            if tag[1]:
                yield "close", name, ""
            else:
                yield "open", name, raw
                if name in _RAW and not _closed(raw) and name not in endless:
                    found = _ENDS[name].search(page, end)
                    if found is not None:
                        end = found.start()
                    elif name in ("script", "style", "textarea", "title"):
                        return
                    else:
                        endless.add(name)
        start = at = end


def _closed(raw: str) -> bool:
    """Whether the tag closes itself; the slash of ``class=x/`` belongs to the value."""
    return raw.endswith("/") and not _UNQUOTED.search(raw[-2000:])


def _spared(events: list, named: dict[int, tuple[str, str]]) -> set[int]:
    """Openings (by place) of elements with a noise name that hold most of the text, or the page's only article or main."""
    stack, done, total, outside = [["", -1, 0, False, False]], [], 0, False  # tag, place if named as noise, characters, main within, dropped
    opened, names_open = Counter(), 0

    def pop() -> None:
        nonlocal names_open
        tag, at, size, main, dropped = stack.pop()
        opened[tag] -= 1
        if at >= 0:
            names_open -= 1
            done.append((at, size, main))
        if not dropped or stack[-1][4]:
            stack[-1][2] += size
            stack[-1][3] |= main

    for at, (kind, value, raw) in enumerate(events):
        top = stack[-1]
        if kind == "text":
            if not top[4] and not value.isspace():
                top[2] += len(value)
                total += len(value)
        elif kind == "open":
            if value in _VOID or _closed(raw):
                continue
            names = named[at][1] if at in named else ""
            noise = names and value not in _UNNAMED and _NOISE.search(names)
            if value in ("article", "main") and not top[4]:
                top[3] = True
                outside |= not names_open
            stack.append([value, at if noise else -1, 0, False, top[4] or value in _DROPPED])
            opened[value] += 1
            names_open += bool(noise)
        elif opened[value]:
            while stack[-1][0] != value:
                pop()
            pop()
    while len(stack) > 1:
        pop()
    return {at for at, size, main in done if 2 * size > total or (main and not outside)}


def _walk(page: str, wanted: int | None, by_name: bool = True):
    """What the page's containers score and hold, by path; or with ``wanted`` the blocks under that path (0: all)."""
    chain = [_Container("", "", None)]  # open block elements
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # all open elements: tag, boring, in a link
    opened: Counter = Counter()
    inside, parts = int(wanted == 0), []
    found: dict[int, list] = {}  # score, held, scope, depth, label
    blocks: list[str] = []

    def end_block() -> None:
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append(text)

    def pop() -> None:
        nonlocal inside
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tag not in _BLOCK:
            return
        node = chain.pop()
        if wanted is not None:
            if node.key == wanted:
                end_block()
                inside -= 1
        elif node.held or node.score:
            own = found.setdefault(node.key, [0.0, 0, node.scope, node.depth, node.label])
            own[0] += node.score
            own[1] += node.held
            chain[-1].held += node.held

    events = list(_events(page))
    named = {at: _attributes(raw) for at, (kind, _, raw) in enumerate(events) if kind == "open" and "=" in raw}
    spared = _spared(events, named) if by_name and any(_NOISE.search(names) for _, names in named.values()) else set()
    for at, (kind, value, raw) in enumerate(events):
        _, boring, link = stack[-1]
        if kind == "text":
            if boring:
                continue
            if wanted is not None:
                if inside:
                    parts.append(value)
            elif not link and not value.isspace():
                size, share = len(value), 1.0
                chain[-1].held += size
                depth = len(chain) - 1 - (chain[-1].tag in _PARAGRAPH)
                while depth > 0 and share > 0.2:  # the container of the paragraph, and half as much the one around it
                    chain[depth].score += size * share
                    share /= 2
                    depth -= 1
        elif kind == "open":
            tag = value
            if tag == "br":
                if inside and not boring:
                    parts.append(" ")
                continue
            if tag in _BLOCK:
                if any(n[0] == "p" for n in stack[-4:]):  # a paragraph ends where a block begins
                    while stack[-1][0] != "p":
                        pop()
                    pop()
                elif tag in ("li", "td", "th", "tr", "dd", "dt") and stack[-1][0] == tag:
                    pop()
                if inside:
                    end_block()
                _, boring, link = stack[-1]
            if tag in _VOID or _closed(raw):
                continue
            classes, names = named.get(at, ("", ""))
            boring = boring or tag in _DROPPED or bool(by_name and names and tag not in _UNNAMED and at not in spared and _NOISE.search(names))
            stack.append((tag, boring, link or tag == "a"))
            opened[tag] += 1
            if tag in _BLOCK:
                chain.append(_Container(tag, f"{tag}{'.' + classes if classes else ''}", chain[-1]))
                if wanted is not None and chain[-1].key == wanted:
                    inside += 1
        else:
            if inside and value in _BLOCK and not boring:
                end_block()
            if opened[value]:
                while stack[-1][0] != value:
                    pop()
                pop()
    while len(stack) > 1:
        pop()
    end_block()
    return found if wanted is None else blocks


def text_under(page: str, path: int) -> str | None:
    """Blocks under the path, one a line; None if the page has no text there."""
    blocks = _walk(page, path)
    return "\n".join(blocks) if blocks else None


def climbed(path: int, found: dict[int, list]) -> int:
    """The lowest container, up to main or body and not below the path, that holds all the text there."""
    _, _, scope, deepest, _ = found[path]
    return max((p for p, (_, _, own, depth, _) in found.items() if own == scope and depth <= deepest), key=lambda p: (found[p][1], found[p][3], p))


def main_text(page: str, path: int | None) -> str:
    if path is not None:
        text = text_under(page, path)
        if text is not None:
            return text
    found = _walk(page, None)
    best = max((p for p in found if found[p][0] > 0), key=lambda p: (found[p][0], p), default=None)
    if best is not None:
        text = text_under(page, climbed(best, found))
        if text is not None:
            return text
    return "\n".join(_walk(page, 0) or _walk(page, 0, by_name=False))


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, label): the key and last label of each host's path with the most votes, climbed; a page's votes are its
    containers' shares of its score."""

    def votes(batches):
        def rows(total):
            columns = list(zip(*((host, path, round(v[0] * 1000), *v[1:]) for (host, path), v in total.items()), strict=True)) or [[]] * 7
            kinds = (pa.string(), *(pa.int64(),) * 5, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "votes", "held", "scope", "depth", "label"])

        for batch in batches:
            total: dict[tuple[str, int], list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _walk(page, None) if page else {}
                whole = sum(v[0] for v in found.values())
                for path, (score, held, scope, depth, label) in found.items():
                    sums = total.setdefault((host, path), [0.0, 0, scope, depth, label])
                    sums[0] += score / whole if whole else 0.0
                    sums[1] += held
                if len(total) > 100_000:
                    yield rows(total)
                    total = {}
            yield rows(total)

    kind = "host string, path long, votes long, held long, scope long, depth long, label string"
    cast = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(votes, kind)
    sums = stored(cast.groupBy("host", "path", "scope", "depth").agg(F.sum("votes").alias("votes"), F.sum("held").alias("held"), F.min("label").alias("label")), "votes")
    best = sums.where("votes > 0").groupBy("host").agg(F.max_by(F.struct("scope", "depth"), F.struct("votes", "path")).alias("best"))
    above = sums.join(best, "host").where("scope = best.scope and depth <= best.depth")
    return above.groupBy("host").agg(F.max_by(F.struct("path", "label"), F.struct("held", "depth", "path")).alias("w")).select("host", "w.path", "w.label")


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), container (the last label of the host's winning path, null if none).

    pages(page_id, url, html, ...): a null or empty html, or one without text, gives an empty text; a null url or one
    without a host votes with the others of the kind; pages of any length and depth are read whole; repeated rows give a
    row each; ties between paths go to the greater key; other columns are ignored; an empty table gives no rows.
    """
    paths = stored(winning_paths(pages), "paths")
    joined = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(paths, "host", "left").select("page_id", "url", "path", "html", "label")

    def read(batches):
        for batch in batches:
            texts = [main_text(page, path) if page else "" for path, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(4)], ["page_id", "url", "text", "n_chars", "container"])

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long, container string")

"""Main text of web pages by union-free regular-expression wrappers.

Pages of one host come from few templates.  A page is read as a stream of tag
and text tokens (made well nested: implied end tags are added).  A *wrapper* is
a union-free regular expression over such streams: a sequence of tags with
nested content, constant texts, text slots, optional parts and repeated groups.
It is inferred by aligning pages with it one after another:

* two different texts in the same place become a text slot,
* neighbours of the same shape fold into a repeated group, also groups of up to
  four parts,
* what one side has and the other lacks becomes optional.

Every page of the corpus is aligned.  A task folds its pages into one partial
wrapper per host, bounded by the host's tags and not by its pages; partial
wrappers merge by the same alignment, in two steps so that a large host does
not meet in one task.  From a host's wrapper follows its rule: where the varying,
unlinked text sits.  The rule, and the fixed list of elements that are never
main text, extract each page.  A class word that may as well describe a block of the
article, such as "alert", counts inside the main element only where the wrapper shows
the part constant or linked.
"""

from __future__ import annotations

import html as entities
import json
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

# Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe xmp template noembed noframes svg math".split())
FORMAT = set("b i em strong u s small big tt font span sup sub mark abbr cite q code kbd samp var time bdi bdo del ins".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
               "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
INLINE = FORMAT | {"a", "img", "label"}

# Parts of a page that are never main text: elements, and words of a class or id.
APART = set("nav footer aside form button select dialog menu head object audio video canvas".split())
APART_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent "
    "gdpr popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "comment comments discussion disqus reply replies respond footer masthead toolbar pagination pager".split())
# Words that name such a part outside the main element; inside it they may as well describe the article's own blocks.
DOUBTFUL_WORDS = set("notice notices alert rail widget related recommended share sharing social copyright disclaimer".split())
# Words that say nothing about a part when they stand beside one of the above, as in share-buttons.
NEUTRAL_WORDS = set(
    "area bar block body bottom box button buttons center column container content footer form group header holder icon icons "
    "inner item items left line link links list main my outer page panel post posts right row section site slot text the top "
    "unit wrap wrapper zone js".split())
TEXT_BLOCKS = HEADINGS | set("p li dd dt td th blockquote pre figcaption caption summary address".split())
MAIN = ("article", "main")
MAX_DEPTH, MAX_PARTS, MAX_PERIOD = 150, 64, 4
NOT_APART, DOUBTFUL, CERTAIN = 0, 1, 2

# A quote opens a value only after an equals sign and if it is closed; else it is part of a name.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>))"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:{_VALUE})?+|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")


class Node:
    """An element of a page: key (tag, class and id), tag that counts, tag as
    written, whether it is never main text, content."""
    __slots__ = ("key", "tag", "name", "apart", "content")

    def __init__(self, key: str, tag: str, name: str, apart: int, content: list | None = None):
        self.key, self.tag, self.name, self.apart = key, tag, name, apart
        self.content = [] if content is None else content


def _named_apart(value: str) -> int:
    """Whether a class or id names a part that is never main text.  A name of
    several words does if all of them belong to such a part: ``share-buttons``,
    but not ``share-price``."""
    level = NOT_APART
    for name in value.split():
        words = set(re.findall(r"[a-z]+", name))
        if words & APART_WORDS and words <= APART_WORDS | DOUBTFUL_WORDS | NEUTRAL_WORDS:
            return CERTAIN
        if words & DOUBTFUL_WORDS and words <= DOUBTFUL_WORDS | NEUTRAL_WORDS:
            level = DOUBTFUL
    return level


_known: dict[tuple[str, str], tuple[str, str, int]] = {}


def _describe(tag: str, attributes: str) -> tuple[str, str, int]:
    """(key, tag that counts, never main text)."""
    got = _known.get((tag, attributes))
    if got:
        return got
    key, counts = tag, tag
    apart = CERTAIN if tag in APART else NOT_APART
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            apart = CERTAIN
        elif name == "role":
            if value == "main":
                counts = "main"
            if value in ("navigation", "banner", "complementary", "contentinfo", "search"):
                apart = CERTAIN
        elif name in ("class", "id"):
            if tag not in ("html", "body", *MAIN):
                apart = max(apart, _named_apart(value))
            key += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value)
    if len(_known) > 50_000:
        _known.clear()
    _known[tag, attributes] = key, counts, apart
    return key, counts, apart


def parse(page: str) -> Node:
    """The page as a tree; unknown or broken markup never fails.

    Below ``MAX_DEPTH`` open elements the tree is flat: the content of deeper
    ones goes to the element at that depth, in order, but for parts that are never
    main text, which keep their own."""
    root = Node("", "", "", NOT_APART)
    stack = [root]
    count: dict[str, int] = {}  # open elements by tag
    at, size = 0, len(page)

    def text(lo: int, hi: int) -> None:
        if lo < hi:
            piece = page[lo:hi]
            if "&" in piece:
                piece = entities.unescape(piece)
            stack[-1].content.append(piece)

    def close(k: int) -> None:
        ends_block = len(stack) > MAX_DEPTH and stack[k].tag not in INLINE
        for node in stack[k:]:
            count[node.name] -= 1
        del stack[k:]
        if ends_block:
            stack[-1].content.append(Node("br", "br", "br", NOT_APART))

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            break
        text(at, m.start())
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                stack[-1].content.append(Node("br", "br", "br", NOT_APART))
            elif count.get(tag) and tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == tag:
                        close(k)
                        break
                    if tag in FORMAT and stack[k].tag not in INLINE:
                        break
            continue
        if tag in ("html", "body"):
            if len(stack) > 1:
                close(1)
            continue
        if tag in CLOSES_P and count.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES and any(count.get(t) for t in CLOSES[tag][0]):
            ends, scope = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in ends:
                    close(k)
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        key, counts, apart = _describe(tag, m.group(3))
        node = Node(key, counts, tag, apart)
        stack[-1].content.append(node)
        if tag not in VOID and not m.group().endswith("/>"):
            if len(stack) >= MAX_DEPTH and apart <= stack[-1].apart:
                node = Node(key, counts, tag, stack[-1].apart, stack[-1].content)
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
    text(at, size)
    return root


# A wrapper part is one of
#   ["t", constant or None for a slot, optional, characters]
#   ["e", key, tag, never main text, optional, repeated, parts]
#   ["g", optional, repeated, parts]

def _key(part) -> str:
    return "#" if part[0] == "t" else part[1] if part[0] == "e" else "(" + " ".join(map(_key, part[3])) + ")"


def _with(part, optional: bool = False, repeated: bool = False):
    if part[0] == "t":
        part[2] |= optional
        if repeated:
            part[1] = None
    else:
        k = 4 if part[0] == "e" else 1
        part[k] |= optional
        part[k + 1] |= repeated
    return part


def wrapper_of(node: Node) -> list:
    """The parts of one page: formatting is part of the text around it."""
    parts: list = []

    def add_text(piece: str) -> None:
        words = " ".join(piece.split())
        if words:
            if parts and parts[-1][0] == "t":
                if parts[-1][1] is not None:
                    parts[-1][1] += " " + words
                parts[-1][3] += len(words)
            else:
                parts.append(["t", words, False, len(words)])

    def walk(content) -> None:
        for c in content:
            if isinstance(c, str):
                add_text(c)
            elif c.tag in FORMAT and not c.apart:
                walk(c.content)
            elif c.tag != "br":
                parts.append(["e", c.key, c.tag, c.apart, False, False, wrapper_of(c)])
    walk(node.content)
    for p in parts:
        if p[0] == "t" and p[1] is not None and len(p[1]) > 200:
            p[1] = None  # long texts are content, not template
    return fold(parts)


def merge_part(a, b):
    """One part that matches what either matches (same key)."""
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] or b[2], a[3] + b[3]]
    if a[0] == "e":
        return ["e", a[1], a[2], max(a[3], b[3]), a[4] or b[4], a[5] or b[5], align(a[6], b[6])]
    return ["g", a[1] or b[1], a[2] or b[2], [merge_part(x, y) for x, y in zip(a[3], b[3])]]


def fold(parts: list) -> list:
    """Neighbours of the same key, and groups of them, become repeated."""
    out: list = []
    for p in parts:
        if out and p[0] != "t" and _key(out[-1]) == _key(p):
            out[-1] = _with(merge_part(out[-1], p), repeated=True)
        else:
            out.append(p)
    for period in range(2, MAX_PERIOD + 1):
        if len(out) < 2 * period:
            break
        keys = [_key(p) for p in out]
        k, folded = 0, []
        while k < len(out):
            group = ["g", False, True, out[k:k + period]]
            end = k + period
            while end + period <= len(out) and keys[k:k + period] == keys[end:end + period]:
                group[3] = [merge_part(x, y) for x, y in zip(group[3], out[end:end + period])]
                end += period
            if end > k + period:
                folded.append(group)
                k = end
            else:
                folded.append(out[k])
                k += 1
        out = folded
    if len(out) > MAX_PARTS:  # too varied for an order: each kind of part once
        kinds: dict[str, list] = {}
        for p in out:
            k = _key(p)
            kinds[k] = merge_part(kinds[k], p) if k in kinds else p
        out = [_with(p, optional=True, repeated=True) for p in kinds.values()]
    return out


def align(a: list, b: list) -> list:
    """The wrapper of two part sequences."""
    ka, kb = [_key(p) for p in a], [_key(p) for p in b]
    if ka == kb:
        return [merge_part(x, y) for x, y in zip(a, b)]
    lo = 0
    while lo < min(len(ka), len(kb)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(ka), len(kb)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    n, m = len(a) - lo - hi, len(b) - lo - hi
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = (best[i + 1][j + 1] + 1 if ka[lo + i] == kb[lo + j] else max(best[i + 1][j], best[i][j + 1]))
    out = [merge_part(x, y) for x, y in zip(a[:lo], b[:lo])]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and ka[lo + i] == kb[lo + j]:
            out.append(merge_part(a[lo + i], b[lo + j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_with(a[lo + i], optional=True))
            i += 1
        else:
            out.append(_with(b[lo + j], optional=True))
            j += 1
    out += [merge_part(x, y) for x, y in zip(a[len(a) - hi:], b[len(b) - hi:])] if hi else []
    return fold(out)


def _is_template(part, linked: bool = False) -> bool:
    """Whether all text of a part is linked, or the same wherever it was seen
    more than once."""
    if part[0] == "t":
        return linked or part[1] is not None and part[3] > 1.5 * len(part[1])
    return all(_is_template(p, linked or (part[0] == "e" and part[2] == "a")) for p in (part[6] if part[0] == "e" else part[3]))


def _template_keys(parts: list):
    """Keys of the parts whose class leaves in doubt what they are, but which
    the pages show to be template."""
    for p in parts:
        if p[0] == "g" or p[0] == "e" and p[3] < DOUBTFUL:
            yield from _template_keys(p[3] if p[0] == "g" else p[6])
        elif p[0] == "e" and p[3] == DOUBTFUL:
            if _is_template(p):
                yield p[1]
            else:
                yield from _template_keys(p[6])


def rule_of(parts: list) -> dict:
    """``path``: keys on the way from the top to the element that holds the main
    text (empty: the whole page); ``template``: keys of parts inside that are not
    main text after all."""
    path, part = _place_of(parts)
    return {"path": path, "template": sorted(set(_template_keys(part[6]))) if part else []}


def _place_of(parts: list) -> tuple[list[str], list | None]:
    def varying(part, linked: bool = False) -> int:
        if part[0] == "t":
            return 0 if linked or part[1] is not None else part[3]
        if part[0] == "e" and part[3]:
            return 0
        inner = part[6] if part[0] == "e" else part[3]
        return sum(varying(p, linked or (part[0] == "e" and part[2] == "a")) for p in inner)

    def elements(inner):
        for p in inner:
            if p[0] == "g":
                yield from elements(p[3])
            elif p[0] == "e" and not p[3]:
                yield p

    def named(inner, path):
        for p in elements(inner):
            if p[2] in MAIN:
                yield path + [p[1]], p
            else:
                yield from named(p[6], path + [p[1]])
    found = [(sum(map(varying, p[6])), path, p) for path, p in named(parts, [])]
    if found:
        amount, path, part = max(found, key=lambda x: x[0])
        inner = [(sum(map(varying, p[6])), q, p) for q, p in named(part[6], path)]
        deepest = max(inner, key=lambda x: x[:2], default=None)
        if deepest and deepest[0] * 2 > amount > 0:
            return deepest[1:]
        return path, part
    path, inner, part = [], parts, None
    while True:
        own = sum(varying(p) for p in inner if p[0] == "t")
        total = sum(map(varying, inner))
        best = max(elements(inner), key=varying, default=None)
        if best is None or best[2] in HEADINGS | INLINE | {"p", "li", "td", "tr", "dd", "dt", "pre", "blockquote"} \
                or best[5] or varying(best) < 0.8 * total or own > 0.2 * total:
            return path, part
        path, inner, part = path + [best[1]], best[6], best


def _places(root: Node, path: list[str]) -> list[Node]:
    nodes = [root]
    for key in path:
        nodes = [c for n in nodes for c in n.content if not isinstance(c, str) and c.key == key and not c.apart]
    return nodes


def _named(node: Node) -> list[Node]:
    out = []
    for c in node.content:
        if not isinstance(c, str) and not c.apart:
            out += [c] if c.tag in MAIN else _named(c)
    return out


def main_text(root: Node, path: list[str], template: list[str] = ()) -> str:
    """The blocks of the rule's element, or of the page's own main elements
    where the page has no such element, joined by line breaks.

    Inside, a block of text whose class leaves in doubt what it is stays, unless the
    host's pages show it to be template; a container of such a class goes."""
    places = _places(root, path) or _named(root) or [root]
    inside = bool(path) or places != [root]

    def left_out(c: Node) -> bool:
        if c.apart == DOUBTFUL and inside:
            return c.key in template or c.tag not in TEXT_BLOCKS | INLINE
        return c.apart != NOT_APART or c.tag == "header" and not inside
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        words = " ".join("".join(run).split())
        if words:
            blocks.append(words)
        run.clear()

    def walk(node: Node) -> None:
        for c in node.content:
            if isinstance(c, str):
                run.append(c)
            elif left_out(c):
                end()
            elif c.tag in INLINE:
                walk(c)
            else:
                end()
                walk(c)
                end()
    for place in places:
        walk(place)
        end()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def _partial_wrappers(batches):
    """(host, salt, wrapper) of the pages of a task."""
    from pyspark import TaskContext
    task = TaskContext.get()
    salt = task.partitionId() % 32 if task else 0
    made: dict[str, list] = {}
    for batch in batches:
        urls, pages = batch.column("url"), batch.column("html")
        for k in range(batch.num_rows):
            host = host_of(urls[k].as_py())
            parts = wrapper_of(parse(pages[k].as_py() or ""))
            made[host] = align(made[host], parts) if host in made else parts
        if len(made) > 2000:
            yield _wrapper_rows(made, salt)
            made = {}
    if made:
        yield _wrapper_rows(made, salt)


def _wrapper_rows(made: dict[str, list], salt: int):
    return pa.RecordBatch.from_pydict({"host": pa.array(list(made), pa.string()),
                                       "salt": pa.array([salt] * len(made), pa.int32()),
                                       "wrapper": pa.array([json.dumps(w) for w in made.values()], pa.string())})


def _merged(pdf):
    import pandas as pd
    whole = None
    for w in sorted(pdf["wrapper"]):
        parts = json.loads(w)
        whole = parts if whole is None else align(whole, parts)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(whole)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON of its parts)."""
    partial = (pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
               .mapInArrow(_partial_wrappers, "host string, salt int, wrapper string"))
    half = partial.groupBy("host", "salt").applyInPandas(_merged, "host string, wrapper string")
    return half.groupBy("host").applyInPandas(_merged, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars (code points); columns of ``pages``
    with these names are replaced.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by one line break in page order; a
    ``br`` ends a block.  Null and empty pages, and pages without main text, give
    the empty text.  A null or malformed url belongs to the host "".  Repeated
    rows are extracted alike; an empty table gives an empty result.
    """
    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of)

    def ruled(batches):
        for batch in batches:
            rules = [json.dumps(rule_of(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "rule": pa.array(rules, pa.string())})
    # written, so that the join knows the rules' size before the pages are read
    rules = stored(infer_wrappers(pages).mapInArrow(ruled, "host string, rule string"), "rules")
    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [c for c in pages.columns if c not in added.names]
    packed = pages.select(F.struct(*[pages[c] for c in names if c != "html"]).alias("row"),
                          pages["html"].cast("string").alias("html"), host(pages["url"].cast("string")).alias("host"))

    def extracted(batches):
        for batch in batches:
            sources, paths = batch.column("html"), batch.column("rule")
            texts = [main_text(parse(sources[k].as_py() or ""), **json.loads(paths[k].as_py() or '{"path": []}'))
                     for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), sources, pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["row", "html", *added.names])
    schema = T.StructType([packed.schema["row"], packed.schema["html"], *added.fields])
    out = packed.join(rules, "host", "left").select("row", "html", "rule").mapInArrow(extracted, schema)
    return out.select(*[F.col("html") if c == "html" else F.col("row")[c].alias(c) for c in names], *added.names)

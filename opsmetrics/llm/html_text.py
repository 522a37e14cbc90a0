"""Main text of web pages by template deduction over the pages of a host.

1. Tokens. A page is cut into tags, each told apart by its path, and text nodes by path and content.
2. Classes. A token's occurrence vector holds its count on every page of the host. Tokens with one vector form
   an equivalence class. Vectors are never built: each page adds a hash of its number and the count to two
   sums, so classes come from one grouped aggregation with partial sums, and a host of any size is spread.
   A class must occur on half of the host's pages at least.
3. Validity. Each page is read against the classes of its host. A class is ordered if its tokens come in one
   order, again and again; tokens that stand elsewhere in some occurrence leave it. Classes are nested if all
   tokens of one lie in one gap between tokens of the class around it (the one of the parent); a class with tokens in
   several gaps is broken up by them.
4. Roles. A token that lies in several gaps of a valid class plays several roles and is told apart by the gap. The
   new tokens are counted, grouped and checked like others, until nothing changes on any page of the host. The tags
   of the classes are the host's template, with the text nodes among them.
5. Slots. What lies between template tokens is data. A block of the template varies by its characters less those of
   template text, each role by itself. The blocks are added up by the article or main element around them, or stand for themselves; the
   one that varies most is the host's article, whatever its tag, and an article element with template text alone is
   none, nor is a role with more template text than other text. Beside an article element, all others that vary are slots too; beside a block, those with more varying
   paragraphs than template text, at any depth. The text of the slots is extracted in page order, text that all pages
   hold included, without parts marked as menu, notice, advert, form, comment and the like. Inside a slot a name
   (adverts and comments apart) marks nothing where the template shows paragraphs that vary.

A name marks an element by its last word that says what it is: ``share-box`` and ``main-menu`` do, ``related-work``
and ``with-sidebar`` do not. Pages without a slot of their host, and hosts whose pages do not vary, go by the
article or main elements of the page itself. Nothing depends on the number of pages beyond the shares above.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null or empty html gives an empty text; a null URL is the host ``''``; broken and unclosed
markup is read as far as it goes; repeated rows are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_tables, materialise, recorded
from .url_filters import host_of

#: Share of a host's pages that a class must cover.
SUPPORT = 0.5

# Element names of HTML by their role, and names by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select option object".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                             "header hr main nav ol p pre section table ul".split())
CLOSED_BY_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
                     "td": {"tr"}, "th": {"tr"}}
BOUNDARY = frozenset("html body article aside div section main nav footer header form table td th ul ol dl blockquote".split())
SIDE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
SIDE_NAMES = frozenset("promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars menu menus "
                       "nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended newsletter "
                       "subscribe subscription widget login signup search pagination toolbar masthead".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
COMMENTS = frozenset("comment comments disqus replies".split())
NEUTRAL = frozenset("area bar block bottom box button buttons container group holder inner left links list outer panel right section "
                    "slot top unit wrap wrapper".split())
STATES = frozenset("with without has no".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                     r"""|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
_KEY_SIGNS = str.maketrans("/|[]#", "     ")  # signs that part keys
_MARKS = re.compile(r"\[([^\]]*)\]")
_DIGITS = re.compile(r"\d+")
_ROLE = re.compile(r"\[#\d+\]")


def side_word(names: str) -> str | None:
    """The word by which one of an element's names, cut at white space, marks it as beside the article."""
    for name in names.split():
        words = _WORDS.findall(name)
        if words and words[0] in ADVERTS | COMMENTS:
            return words[0]
        while len(words) > 1 and words[-1] in NEUTRAL:
            words.pop()
        if words and words[-1] in SIDE_NAMES | ADVERTS | COMMENTS and STATES.isdisjoint(words):
            return words[-1]
    return None


class Node:
    """An open element: its tag, the key of its path, whether it is marked as beside the article, by its tag or role (hard) or by the names of the elements in ``named``."""

    __slots__ = ("tag", "key", "hard", "named", "side", "parent")

    def __init__(self, tag: str, key: str, hard: bool, named: tuple[str, ...] = (), parent: Node | None = None):
        self.tag, self.key, self.hard, self.named, self.side, self.parent = tag, key, hard, named, hard or bool(named), parent


def _opened(tag: str, rest: str, parent: Node) -> Node:
    marks, hard, beside = "", tag in SIDE_TAGS or tag == "header" and not _holds_article(parent), False
    if "=" in rest:
        found = {name.lower(): (a or b or c).lower() for name, a, b, c in _ATTRIBUTE.findall(rest)}
        names = " ".join(found[n] for n in ("class", "id") if n in found)
        marks = "".join(f"[{_DIGITS.sub('0', found[n]).translate(_KEY_SIGNS)}]" for n in ("class", "id", "role", "itemprop") if n in found)
        hard = hard or found.get("role") in SIDE_ROLES
        word = side_word(names)
        # Inside an article a name marks boxes; paragraphs only as adverts.
        beside = word is not None and tag not in ("html", "body") and (word in ADVERTS or not (tag in PROSE and _holds_article(parent)))
    key = f"{parent.key}/{tag.translate(_KEY_SIGNS)}{marks}"
    return Node(tag, key, hard or parent.hard, (*parent.named, key) if beside else parent.named, parent)


def _holds_article(node: Node) -> bool:
    return "/article" in node.key or "/main" in node.key


def parse(page: str) -> Iterator[tuple[str, Node, str]]:
    """('open', element, ''), ('text', element, raw text) and ('break', element, '') in page order."""
    root = Node("", "", False)
    stack, at, n = [root], 0, len(page)

    def close(tags, boundary) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in boundary:
                return

    while at < n:
        match = _MARKUP.search(page, at)
        if match is None:
            yield "text", stack[-1], page[at:]
            return
        if match.start() > at:
            yield "text", stack[-1], page[at:match.start()]
        at = match.end()
        name = match["name"]
        if not name:
            continue
        tag = name.lower()
        if match["end"]:
            close((tag,), ())
        else:
            if tag in CLOSES_PARAGRAPH:
                close(("p",), BOUNDARY)
            if tag in CLOSED_BY_SIBLING:
                close((tag, "dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), CLOSED_BY_SIBLING[tag])
            node = _opened(tag, match["rest"], stack[-1])
            yield "open", node, ""
            if tag in RAW and not match["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not match["rest"].endswith("/"):
                stack.append(node)
        if tag not in INLINE:
            yield "break", stack[-1], ""


def read(page: str) -> list[tuple[str, Node, str]]:
    """The events of a page. A name does not mark what holds the article: names that leave no text, or that cover the only articles and more text than is left, are freed from the outside."""
    events = list(parse(page))
    texts = [(node, n) for kind, node, raw in events if kind == "text" and not node.hard and (n := len(raw.strip()))]
    nodes = {id(node): node for _, node, _ in events if node.named}.values()
    while any(node.named for node, _ in texts):
        left = sum(n for node, n in texts if not node.side)
        covered, articles = Counter(), Counter()
        for node, n in texts:
            if node.named:
                covered[node.named[0]] += n
                articles[node.named[0]] += n * _holds_article(node)
        pick = max(covered, key=lambda k: (articles[k], covered[k], k))
        lost = not any(not node.side and _holds_article(node) for node, _ in texts) and articles[pick] > left
        if left and not lost:
            break
        for node in nodes:
            node.named = tuple(k for k in node.named if k != pick)
            node.side = node.hard or bool(node.named)
    return events


def text_key(node: Node, text: str) -> str:
    return f"{node.key}|{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def block_of(key: str) -> str:
    """The key of the element that is the block of a text."""
    parts = key.split("/")
    while len(parts) > 2 and parts[-1].split("[")[0] in INLINE | PROSE | {"li", "ul", "ol"}:
        parts.pop()
    return "/".join(parts)


def squeeze(raw: str) -> str:
    return " ".join(entities.unescape(raw).split())


def page_counts(page: Outline, roles: Roles) -> tuple[Counter, Counter]:
    """Counts of all tokens, and characters of text by its token and by the key of its block."""
    keys = keys_of(page.parents, page.names, roles)
    chars = Counter()
    for parent, key, n in zip(page.parents, keys, page.chars):
        if n:
            chars[block_of(keys[parent] if parent >= 0 else "")] += n
            chars[key] += n
    return Counter(keys), chars


def page_tokens(page: str) -> tuple[Counter, Counter]:
    return page_counts(outline(read(page))[0], Roles())


class Outline(NamedTuple):
    """The tags and texts of a page in order: the place of the parent (-1: none), the last part of the token, and the characters of text."""

    parents: list[int]
    names: list[str]
    chars: list[int]


class Roles(NamedTuple):
    """How a host's tokens are told apart: tokens with the number of a class, and the tokens of these classes with their ranks, by which gaps are known."""

    told: dict[str, int] = {}
    marks: dict[str, list[tuple[int, int]]] = {}


def outline(events: list[tuple[str, Node, str]]) -> tuple[Outline, dict[int, int]]:
    """The outline of a page, and the places of its elements."""
    out, places = Outline([], [], []), {}
    for kind, node, raw in events:
        if kind == "open":
            places[id(node)] = len(out.names)
            parent, name, chars = places.get(id(node.parent), -1), "/" + node.key.rsplit("/", 1)[1], 0
        elif kind == "text" and (text := squeeze(raw)):
            parent, name, chars = places.get(id(node), -1), text_key(node, text)[len(node.key):], 0 if node.side else len(text)
        else:
            continue
        for column, value in zip(out, (parent, name, chars)):
            column.append(value)
    return out, places


def keys_of(parents: list[int], names: list[str], roles: Roles) -> list[str]:
    """The token of each place of an outline; one that is told apart gets the rank of its class's last token before it."""
    told, marks = roles
    keys: list[str] = []
    gap: dict[int, int] = {}
    for parent, name in zip(parents, names):
        key = keys[parent] + name if parent >= 0 else name
        while key in told:
            key += f"[#{gap[told[key]]}]"
        for group, rank in marks.get(key, ()):
            gap[group] = rank
        keys.append(key)
    return keys


def plain(key: str) -> str:
    """A key without roles."""
    return _ROLE.sub("", key) if "#" in key else key


def parent_of(token: str) -> str:
    return token.split("|", 1)[0] if "|" in token else token.rpartition("/")[0]


_OUTLINES = "host string, pages array<struct<page: bigint, parents: array<int>, names: array<string>, chars: array<int>>>"
_TOKENS = "host string, page bigint, token string, n bigint, chars bigint"
_TOLD = "array<struct<token: string, grp: bigint>>"
_MARKS_TYPE = "array<struct<token: string, grp: bigint, rank: bigint>>"
_CUTS = "array<struct<token: string, cut: bigint>>"
_CHECKS = "host string, token string, low bigint, high bigint, first string, last string"
_PAGES_ARROW = pa.list_(pa.struct([("page", pa.int64()), ("parents", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("chars", pa.list_(pa.int32()))]))
_TOLD_ARROW = pa.list_(pa.struct([("token", pa.string()), ("grp", pa.int64())]))
_MARKS_ARROW = pa.list_(pa.struct([("token", pa.string()), ("grp", pa.int64()), ("rank", pa.int64())]))
_CUTS_ARROW = pa.list_(pa.struct([("token", pa.string()), ("cut", pa.int64())]))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outlines of 200 pages at once, by host, so that what is known of a host goes out once for them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            held: dict[str, list[dict]] = {}
            for host, uid, page in zip(*(part.column(n).to_pylist() for n in ("host", "uid", "html"))):
                held.setdefault(host, []).append({"page": uid, **outline(read(page))[0]._asdict()})
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), _PAGES_ARROW)], names=["host", "pages"])


def _roles(told: list[dict] | None, marks: list[dict] | None) -> Roles:
    by_token: dict[str, list[tuple[int, int]]] = {}
    for x in marks or ():
        by_token.setdefault(x["token"], []).append((x["grp"], x["rank"]))
    return Roles({x["token"]: x["grp"] for x in told or ()}, by_token)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for host, pages, told, marks in zip(*(batch.column(n) for n in ("host", "pages", "told", "marks"))):
            roles, host = _roles(told.as_py(), marks.as_py()), host.as_py()
            out: tuple[list, ...] = ([], [], [], [], [])
            for page in pages.as_py():
                counts, sizes = page_counts(Outline(page["parents"], page["names"], page["chars"]), roles)
                for token, n in counts.items():
                    for column, value in zip(out, (host, page["page"], token, n, sizes.pop(token, 0))):
                        column.append(value)
                # One row a page without a token counts the page itself.
                for column, value in zip(out, (host, page["page"], "", 1, 0)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["host", "page", "token", "n", "chars"])


def templates(tokens: DataFrame, support: float = SUPPORT) -> DataFrame:
    """For each host its pages and its template: tokens of valid classes with the class, pages, count and text.

    A token that covers a given share of the pages appears on a page on average that often, so a template is
    at most 1/support times as long as a page's list of distinct tokens.
    """
    mix = F.xxhash64("page", "n")
    counted = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"),
        F.sum(F.shiftrightunsigned(mix, 33)).alias("v1"), F.sum(mix.bitwiseAND(F.lit((1 << 31) - 1))).alias("v2"))
    counted = materialise(counted.where("pages > 1 or token = ''"))
    pages = counted.where("token = ''").select("host", F.col("pages").alias("host_pages"))
    frequent = counted.where("token <> ''").join(pages, "host").where(F.col("pages") >= F.col("host_pages") * F.lit(support))
    entry = F.struct("token", F.xxhash64("pages", "total", "v1", "v2").alias("class"), "pages", "total", "chars")
    listed = frequent.groupBy("host").agg(F.collect_list(entry).alias("template"))
    return pages.join(listed, "host", "left")


def check_pages(entries: list[dict], cuts: dict[str, int], roles: Roles, pages: list[dict]) -> dict[str, list]:
    """Of each token of the template the least and greatest rank in its class's occurrences, and the least and greatest of the tokens at which the gaps around it begin."""
    class_of = {e["token"]: (e["class"], cuts.get(e["token"], 0)) for e in entries}
    sizes = Counter(class_of.values())
    found: dict[str, list] = {}
    for page in pages:
        keys = keys_of(page["parents"], page["names"], roles)
        seen: dict[tuple, int] = {}
        last: dict[tuple, str] = {}
        gaps: list[str] = []
        for parent, key in zip(page["parents"], keys):
            mine, above = class_of.get(key), class_of.get(keys[parent]) if parent >= 0 else None
            gap = "" if above is None else gaps[parent] if above == mine else last[above]
            gaps.append(gap)
            if mine is None:
                continue
            n = seen[mine] = seen.get(mine, -1) + 1
            last[mine] = key
            rank = n % sizes[mine]
            x = found.get(key)
            if x is None:
                found[key] = [rank, rank, gap, gap]
                continue
            if rank < x[0]:
                x[0] = rank
            elif rank > x[1]:
                x[1] = rank
            if gap < x[2]:
                x[2] = gap
            elif gap > x[3]:
                x[3] = gap
    return found


def _number(*parts) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def settle(entries: list[dict], checks: list[dict], cuts: dict[str, int]) -> tuple[dict[str, int], dict[str, int], list[tuple[str, int, int]]]:
    """From what the pages say of a host's classes: new cuts, by which tokens leave their class, tokens to be told apart, and the tokens of the classes that do so."""
    class_of = {e["token"]: (e["class"], cuts.get(e["token"], 0)) for e in entries}
    known = {x["token"]: x for x in checks}
    moved = {t for t, x in known.items() if x["low"] != x["high"]}
    unordered = {class_of[t] for t in moved}
    out = {t: _number(class_of[t], t) for t in moved}
    members: dict[tuple, list[str]] = {}
    for t in sorted(known):
        members.setdefault(class_of[t], []).append(t)
    group = {c: _number(c, *tokens) for c, tokens in members.items()}
    told: dict[str, int] = {}
    around: set[tuple] = set()
    for own, tokens in members.items():
        ordered = [t for t in tokens if own not in unordered and class_of.get(known[t]["first"]) not in unordered]
        steady = [t for t in ordered if known[t]["first"] == known[t]["last"]]
        if len({known[t]["first"] for t in steady}) > 1:
            out.update((t, _number(own, known[t]["first"])) for t in steady)
        for t in ordered:
            above = class_of.get(parent_of(t))
            if known[t]["first"] != known[t]["last"] and above not in unordered and above not in (None, own):
                told[t] = group[above]
                around.add(above)
    marks = [(t, group[c], known[t]["low"]) for c in around for t in members[c]]
    return out, told, marks


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("token", "low", "high", "first", "last")
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for host, pages, template, told, marks, cuts in zip(*(batch.column(n) for n in ("host", "pages", "template", "told", "marks", "cuts"))):
            found = check_pages(template.as_py(), {x["token"]: x["cut"] for x in cuts.as_py() or ()}, _roles(told.as_py(), marks.as_py()), pages.as_py())
            columns = zip(*((t, *x) for t, x in found.items())) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(found), pa.string()), *map(pa.array, columns, types)], names=["host", *names])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of each host after a round, and whether that is more than before."""
    for batch in batches:
        for at in range(batch.num_rows):
            template, checks, told, marks, cuts = (batch.column(n)[at].as_py() or [] for n in ("template", "checks", "told", "marks", "cuts"))
            held = {x["token"]: x["cut"] for x in cuts}
            new_cuts, new_told, new_marks = settle(template, checks, held)
            held.update(new_cuts)
            groups = {(x["token"], x["grp"]) for x in marks}
            told += [{"token": t, "grp": g} for t, g in sorted(new_told.items())]
            marks += [{"token": t, "grp": g, "rank": r} for t, g, r in sorted(new_marks) if (t, g) not in groups]
            columns = (pa.array([told], _TOLD_ARROW), pa.array([marks], _MARKS_ARROW),
                       pa.array([[{"token": t, "cut": c} for t, c in sorted(held.items())]], _CUTS_ARROW), pa.array([bool(new_cuts or new_told)]))
            yield pa.RecordBatch.from_arrays([batch.column("host").slice(at, 1), batch.column("template").slice(at, 1), *columns],
                                             names=["host", "template", "told", "marks", "cuts", "changed"])


def settled_templates(outlines: DataFrame, support: float = SUPPORT) -> DataFrame:
    """For each host its template once its classes are ordered and nested and no token lies in several gaps, with its roles.

    Hosts whose classes are valid are done; the others go into a further round with their new tokens.
    """
    none = [F.lit(None).cast(t).alias(n) for n, t in (("told", _TOLD), ("marks", _MARKS_TYPE), ("cuts", _CUTS))]
    rows, done = outlines.select("host", "pages", *none), None
    while True:
        found = templates(rows.mapInArrow(_tokens, _TOKENS), support).where("template is not null").select("host", "template")
        found = materialise(found)
        state = ("told", "marks", "cuts")
        checks = rows.join(found, "host").mapInArrow(_checked, _CHECKS).groupBy("host", "token").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
        checks = checks.groupBy("host").agg(F.collect_list(F.struct("token", "low", "high", "first", "last")).alias("checks"))
        before = rows.groupBy("host").agg(*[F.first(n).alias(n) for n in state])
        schema = f"host string, template {found.schema['template'].dataType.simpleString()}, told {_TOLD}, marks {_MARKS_TYPE}, cuts {_CUTS}, changed boolean"
        after = materialise(found.join(checks, "host").join(before, "host").mapInArrow(_settled, schema))
        steady = after.where("not changed").drop("changed")
        done = steady if done is None else done.unionByName(steady)
        if after.where("changed").isEmpty():
            return done
        rows = outlines.join(after.where("changed").select("host", *state), "host")


class Slots(NamedTuple):
    """What a template says of a host's article: keys of its slots without roles, keys of elements that are none, and keys without roles of elements whose names mark nothing."""

    slots: frozenset[str] = frozenset()
    idle: frozenset[str] = frozenset()
    free: frozenset[str] = frozenset()


def deduce(entries: list[dict]) -> Slots:
    """The slots of a host from the tokens of its classes."""
    tags = {e["token"]: e for e in entries if "|" not in e["token"]}
    # A class nests if the path of each of its tags is made of valid tags.
    valid = {t for t in tags if all(t[:m.start()] in tags for m in re.finditer("/", t) if m.start())}
    fixed, held, prose = Counter(), Counter(), Counter()
    for e in entries:
        key = e["token"].split("|", 1)[0]
        if "|" in e["token"]:
            fixed[block_of(key)] += e["chars"]
            into, weight = held, e["total"]
        elif key in valid and _tag_of(key) in PROSE:
            into, weight = prose, e["total"]
        else:
            continue
        for at in [m.start() for m in re.finditer("/", key)][1:] + [len(key)]:
            into[key[:at]] += weight
    varying = {t: tags[t]["chars"] - fixed[t] for t in valid if tags[t]["chars"]}
    around = Counter()
    for t, n in varying.items():
        around[_article_of(t) or t] += n
    articles = {t for t in valid if _article_of(t) == t}
    idle = {t for t in articles if not around[t]}
    found = [t for t, n in around.items() if n > 0 and _tag_of(t) not in ("html", "body")]
    sums = Counter()
    for t in found:
        sums[plain(t)] += around[t]
    best = max(sums, key=lambda t: (sums[t], -len(t), t), default=None)
    holders = {plain(t) for t in articles}
    if best is None or best not in holders and 2 * sums[best] <= sum(around.values()):
        return Slots(idle=frozenset(idle) if any(around[t] for t in articles) else frozenset())
    if best in holders:
        chosen = {t for t in found if t in articles and _tag_of(t) == _tag_of(best)}
    else:
        # A role of an element that has more template text than other text is none of its slots.
        chosen = {t for t in found if plain(t) == best and (t == best or around[t] > fixed[t])} or {max((t for t in found if plain(t) == best), key=lambda t: (around[t], t))}
        chosen |= {t for t in found if _article_of(t) is None and _tag_of(t) not in INLINE | PROSE and prose[t] > held[t]}
    slots = frozenset(map(plain, chosen))
    idle |= {t for t in valid if t != plain(t) and plain(t) in slots and t not in chosen and varying.get(t, 0) <= fixed[t] and tags[t]["chars"]}
    free = frozenset(plain(t) for t in valid if prose[t] > held[t] and any(plain(t).startswith(f"{x}/") for x in slots)
                     and (word := side_word(" ".join(_MARKS.findall(plain(t).rsplit('/', 1)[-1])))) and word not in ADVERTS | COMMENTS)
    return Slots(slots, frozenset(idle), free)


def _tag_of(key: str) -> str:
    return key.rsplit("/", 1)[-1].split("[")[0]


def _article_of(key: str) -> str | None:
    """The outermost article element of a key, else its outermost main element."""
    for name in ("article", "main"):
        match = re.search(rf"/{name}(?:\[[^/]*)?(?=/|\Z)", key)
        if match:
            return key[:match.end()]
    return None


def _inside(key: str, roots) -> bool:
    return any(key == r or key.startswith(f"{r}/") for r in roots)


def extract(page: str, host: Slots = Slots(), roles: Roles = Roles()) -> str:
    """The main text of one page by the slots and roles of its host."""
    events = read(page)
    key_of = {id(node): node.key for _, node, _ in events}
    if roles.told:
        lines, places = outline(events)
        told = keys_of(lines.parents, lines.names, roles)
        key_of.update((node, told[at]) for node, at in places.items())
    beside = {id(node): node.hard or not host.free.issuperset(node.named) for _, node, _ in events}
    keys = {key_of[id(node)] for kind, node, _ in events if kind == "open" and not beside[id(node)]}
    roots = {k for k in keys if plain(k) in host.slots and k not in host.idle}
    kinds = {_tag_of(k) for k in roots} & {"article", "main"}
    if not roots:
        kinds = {name for name in ("article", "main") if any(_tag_of(k) == name for k in keys)}
        kinds = {"article"} if "article" in kinds else kinds
    named = {k for k in keys if _tag_of(k) in kinds}
    # Article elements that only this page has are slots of their kind.
    roots = roots | {k for k in named if k not in host.idle} or named
    pieces = []
    for kind, node, raw in events:
        if kind == "break":
            pieces.append(" ")
        elif kind == "text" and not beside[id(node)] and (not roots or _inside(key_of[id(node)], roots)):
            pieces.append(entities.unescape(raw))
    return " ".join("".join(pieces).split())


_FIELDS = Slots._fields


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for batch in batches:
        for at in range(batch.num_rows):
            found = deduce(batch.column("template")[at].as_py() or [])
            # Roles travel to the pages only where they part what is a slot from what is none.
            parts = any("#" in k for k in found.idle)
            told, marks = (pa.array([batch.column(n)[at].as_py() if parts else []], t) for n, t in (("told", _TOLD_ARROW), ("marks", _MARKS_ARROW)))
            yield pa.RecordBatch.from_arrays([batch.column("host").slice(at, 1), *[pa.array([sorted(x)], strings) for x in found], told, marks],
                                             names=["host", *_FIELDS, "told", "marks"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = zip(*(batch.column(n).to_pylist() for n in _FIELDS))
        roles = map(_roles, *(batch.column(n).to_pylist() for n in ("told", "marks")))
        texts = [extract(page.as_py(), Slots(*(frozenset(x or ()) for x in host)), role) for page, host, role in zip(batch.column("html"), slots, roles)]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``df``: id, url, text, n_chars."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    with recorded() as on_the_way:
        outlines = materialise(rows.select("host", "uid", "html").mapInArrow(_outlines, _OUTLINES))
        found = settled_templates(outlines, support)
    # Only the few keys of a host's slots travel to its pages, not its template.
    schema = ", ".join(["host string", *[f"{n} array<string>" for n in _FIELDS], f"told {_TOLD}", f"marks {_MARKS_TYPE}"])
    found = materialise(found.select("host", "template", "told", "marks").mapInArrow(_deduced, schema))
    drop_tables(df.sparkSession, on_the_way)
    fields = [T.StructField(n, rows.schema[n].dataType) for n in ("id", "url")]
    out = rows.drop("uid").join(found, "host", "left").mapInArrow(_extract, T.StructType([*fields, T.StructField("text", T.StringType())]))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))

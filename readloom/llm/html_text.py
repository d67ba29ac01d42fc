"""Main text of web pages through wrappers inferred from the pages of the same host.

A page is read as a stream of tokens: block elements and the text blocks between them. A wrapper is a union-free regular expression
over that stream, and is found by aligning the pages of a host, element by element from the root down:

1. Children of one label (tag and class names) are aligned in their order, the k-th with the k-th, as long as every page has the same
   number of them. Where the numbers differ, the mismatch is resolved into a repeated group: all children of this label are one.
2. A place (the labels from the root down, with their k where order counts) that a page lacks becomes optional; a text that differs from the
   one at the same place of another page becomes a text slot, one that never differs stays a constant of the template.

Both steps are associative, so tasks align what they read, and give rows by host and place that are added up, all of them: no task holds a
whole wrapper, and a host of a third of all pages is shared out like any other.

What a page's text is: elements that are chrome by their tag, role or class go (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles); then, if the page has article or main elements, all their blocks stay; else
those below the wrapper's main place: the deepest that holds most of the host's variable text. Constants of the
wrapper (the same on three different pages or more) are dropped outside article and main, and inside where a class or id
marks a block that is the same on five different pages or more, headings excepted. Pages of the same blocks count as one page
there, so copies of a page do not make its text constant; a text on fewer pages counts as variable. On hosts without variable text nothing counts as constant.

Inside a block white space (br included) becomes one space; blocks are joined by two line feeds. Defined cases: null
and empty html give an empty text; unclosed and misnested elements are closed where HTML closes them; a page that ends
within a comment, script or style loses that rest; null or malformed urls form the host ''; rows that repeat
an id are extracted one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, text_or_empty

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CHROME = frozenset(
    "nav footer aside form button select option textarea script style noscript template iframe object svg canvas audio video dialog menu"
    " head title input label map datalist".split()
)
_CHROME_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_CHROME_WORD = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices notification popup modal overlay sidebar sidenav comment comments commentlist respond disqus replies nav navbar navigation"
    " menu submenu breadcrumb breadcrumbs masthead footer share sharing social related recommended recommendations newsletter subscribe"
    " subscription signup login widget widgets pagination pager toolbar topbar skip hidden".split()
)
_HEADER_WORD = frozenset(("header", "topbar", "masthead"))
_NOT_ALNUM = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")
_DEEP = 40
_PLACES = 100_000  # rows that a task holds before it gives them out
_DIFFER = 5  # page hashes that are kept of a place: as many as the decisions ask for
#: Open elements that an opening tag closes, and the elements that stop the search for them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}


class Block:
    """A text block: its place, text and the number of the article or main element that it lies in (0: none)."""

    __slots__ = ("place", "text", "main", "tag", "marked")

    def __init__(self, place: str, text: str, main: int, tag: str, marked: bool):
        self.place, self.text, self.main, self.tag, self.marked = place, text, main, tag, marked


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _words(attrs: dict[str, str]) -> set[str]:
    raw = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return set(_NOT_ALNUM.split(_CAMEL.sub(" ", raw).lower())) - {""} if raw != " " else set()


def _is_chrome(tag: str, attrs: dict[str, str], within_main: bool) -> bool:
    if tag in _CHROME or (tag == "header" and not within_main):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in _CHROME_ROLE:
        return True
    if tag not in _BLOCK:
        return False  # a word of a sentence, whatever its class
    words = _words(attrs)
    return bool(words & _CHROME_WORD) or (not within_main and bool(words & _HEADER_WORD))


class Open:
    """An open element. ``labels`` are those from the root down, ``kids`` how many block elements of each label it has so far."""

    __slots__ = ("tag", "place", "chrome", "main", "marked", "labels", "kids")

    def __init__(self, tag: str, place: str, chrome: bool, main: int, marked: bool, labels: str, kids: dict[str, int]):
        self.tag, self.place, self.chrome, self.main, self.marked, self.labels, self.kids = tag, place, chrome, main, marked, labels, kids


def read_page(html: str, ordered: frozenset[str] = frozenset(), counts: dict[str, list[int]] | None = None) -> tuple[list[Block], Counter[str]]:
    """The text blocks that are not chrome, and how often each place of a block element occurs.

    Elements whose labels are in ``ordered`` are told apart by their number among their like. ``counts`` takes the least and the largest number of
    children by label that an element of the page has.
    """
    blocks: list[Block] = []
    places: Counter[str] = Counter()
    stack = [Open("", "", False, 0, False, "", {})]
    parts: list[str] = []
    began: Open | None = None
    mains = 0

    def flush() -> None:
        nonlocal began
        if began is not None:
            text = _SPACES.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(began.place, text, began.main, began.place.rpartition("/")[2].partition(".")[0], began.marked))
        parts.clear()
        began = None

    def say(text: str) -> None:
        nonlocal began
        top = stack[-1]
        if text and not top.chrome:
            if began is None and not text.isspace():
                began = next((e for e in reversed(stack) if e.tag in _BLOCK), stack[0])
            parts.append(text)

    def close_to(i: int) -> None:
        if any(e.tag in _BLOCK for e in stack[i:]):
            flush()
        if counts is not None:
            for e in stack[i:]:
                for label, n in e.kids.items() if e.tag in _BLOCK or not e.tag else ():
                    least_most = counts.setdefault(f"{e.labels}/{label}", [n, n])
                    least_most[0], least_most[1] = min(least_most[0], n), max(least_most[1], n)
        del stack[i:]

    at = 0
    while m := _TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        tag = m["tag"] and m["tag"].lower()
        if not tag:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main", "table", "section", "div"):
                    break  # a stray end tag does not close what it is not in
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _CLOSES_P or tag in _CLOSES:
            also, stop = _CLOSES.get(tag, (set(), set()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop or stack[i].tag in ("article", "main", "body") or (stack[i].tag in _BLOCK and stack[i].tag not in also and stack[i].tag != "p"):
                    break
                if stack[i].tag in also or (stack[i].tag == "p" and tag in _CLOSES_P):
                    close_to(i)
                    break
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        top = stack[-1]
        attrs = _attributes(m["attrs"])
        main, chrome = top.main, top.chrome
        is_main = tag in ("article", "main") or attrs.get("role") == "main"
        own = _is_chrome(tag, attrs, main > 0)
        if is_main and not own and chrome and not any(e.tag in _CHROME and e.tag != "form" for e in stack):
            chrome = False  # a class such as with-sidebar on what holds the article, or a form around the page
        chrome = chrome or own
        if is_main and not chrome and (main == 0 or tag == "article" and not any(e.tag == "article" for e in stack)):
            mains += 1
            main = mains
        place, labels, marked, kids = top.place, top.labels, top.marked, top.kids
        if tag in _BLOCK:
            names = "".join("." + w for w in sorted(_words(attrs)))
            label = tag + _DIGITS.sub("0", names)
            kids[label] = number = kids.get(label, 0) + 1
            labels = f"{labels}/{label}"
            if labels in ordered:
                label = f"{label}.#{number}"
            if len(stack) > _DEEP:  # a short name for a long path
                label, place = f"{tag}.~{xxhash.xxh64_hexdigest(f'{place}/{label}')}", stack[_DEEP].place
                labels = f"{stack[_DEEP].labels}/~{xxhash.xxh64_hexdigest(labels)}"
            place = f"{place}/{label}"
            marked, kids = bool(names), {}
            places[place] += 1
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if not m["attrs"].endswith("/") or tag in _BLOCK:
            stack.append(Open(tag, place, chrome, main, marked, labels, kids))
    say(html[at:])
    flush()
    close_to(0)
    return blocks, places


class Wrapper:
    """A host's union-free expression: by place (pages that have it, most times on a page, characters, constant, hashes of pages).

    The hashes are the _DIFFER least of the different pages, which is enough to know whether there are so many. The constant is the text's hash while all pages agree, False once it is a slot, None while there is no text.
    """

    def __init__(self, pages: int = 0, places: dict[str, list] | None = None):
        self.pages, self.places = pages, places or {}

    def align(self, blocks: list[Block], places: Counter[str]) -> None:
        """Align one more page."""
        own = [xxhash.xxh64_intdigest("\0".join(x for b in blocks for x in (b.place, b.text))) >> 1]
        page = {p: [1, n, 0, None, own] for p, n in (Counter({"": 1}) | places).items()}
        for b in blocks:
            node = page.setdefault(b.place, [1, 1, 0, None, own])
            h = xxhash.xxh64_intdigest(b.text)
            node[3] = h if node[3] is None or node[3] == h else False
            node[2] += len(b.text)
        self.merge(Wrapper(1, page))

    def merge(self, other: Wrapper) -> None:
        self.pages += other.pages
        for p, (n, most, chars, slot, differ) in other.places.items():
            if (mine := self.places.get(p)) is None:
                self.places[p] = [n, most, chars, slot, differ]
            else:
                mine[0] += n
                mine[1] = max(mine[1], most)
                mine[2] += chars
                mine[3] = slot if mine[3] is None else mine[3] if slot is None or slot == mine[3] else False
                if mine[4] != differ and (len(mine[4]) < _DIFFER or differ[0] < mine[4][-1]):
                    mine[4] = sorted({*mine[4], *differ})[:_DIFFER]

    def expression(self) -> str:
        """The wrapper as a regular expression: ? optional, + repeated, #TEXT slots, constants as #CONST."""
        kids: dict[str, list[str]] = {}
        for p in self.places:
            if p:
                kids.setdefault(p.rpartition("/")[0], []).append(p)

        def write(p: str) -> str:
            n, most, _, slot, _ = self.places[p]
            own = "" if slot is None else " #TEXT" if slot is False else " #CONST"
            inner = own + "".join(" " + write(k) for k in kids.get(p, []))
            return f"(<{p.rpartition('/')[2]}>{inner} </>)" + ("+" if most > 1 else "") + ("?" if n < self.pages else "")

        return " ".join(write(p) for p in kids.get("", []))

    def decisions(self) -> tuple[str, dict[str, int], dict[str, int]]:
        """(main place, constants that go outside article and main, those that go inside as well)."""
        varies = sum(x[2] for x in self.places.values() if x[3] is False or len(x[4]) < 3)
        everything = sum(x[2] for x in self.places.values())
        main, rest = "", {}
        for p, x in self.places.items():
            if x[3] is False or len(x[4]) < 3:
                while p:
                    rest[p] = rest.get(p, 0) + x[2]
                    p = p.rpartition("/")[0]
        whole = max(rest.values(), default=0)
        for p, chars in rest.items():
            if whole and chars >= 0.8 * whole and (len(p), p) > (len(main), main) and p.rpartition("/")[2].partition(".")[0] not in ("p", "li", "h1", "h2"):
                main = p
        if varies < 0.5 * everything:
            return main, {}, {}
        same = {p: x[3] for p, x in self.places.items() if x[3] not in (None, False) and len(x[4]) >= 3}
        return main, same, {p: h for p, h in same.items() if len(self.places[p][4]) >= 5}


def main_text(html: str, decided: tuple[str, dict[str, int], dict[str, int]], ordered: frozenset[str] = frozenset()) -> str:
    """The main text of a page, by the decisions of its host's wrapper and the labels whose order counts there."""
    main, same, same_inside = decided
    blocks, _ = read_page(html, ordered)
    kept = [b for b in blocks if b.main]
    if kept:
        if same_inside:
            kept = [
                b for b in kept
                if not (b.marked and b.tag not in _HEADING and b.place in same_inside and same_inside[b.place] == xxhash.xxh64_intdigest(b.text))
            ]
    else:
        kept = [b for b in blocks if b.place == main or b.place.startswith(main + "/")] or blocks
        kept = [b for b in kept if same.get(b.place) is None or same[b.place] != xxhash.xxh64_intdigest(b.text)]
    return "\n\n".join(b.text for b in kept)


def page_host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def ordered_labels(pages: DataFrame) -> DataFrame:
    """(host, ordered) of a table (host, html): the labels of which every element that has them has the same number, two or more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, list[int]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(h, labels, *n) for h, c in known.items() for labels, n in c.items()]
            known.clear()
            for at in range(0, len(rows), 10_000):
                cols = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "labels", "least", "most"])

        held = 0
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = known.setdefault(host, {})
                held -= len(counts)
                read_page(html.as_py(), counts=counts)
                held += len(counts)
                if held > _PLACES:
                    yield from out()
                    held = 0
        yield from out()

    rows = pages.mapInArrow(partial, "host string, labels string, least long, most long")
    counts = rows.groupBy("host", "labels").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return counts.where("least = most and least > 1").groupBy("host").agg(F.collect_list("labels").alias("ordered"))


class _Ordered:
    """The labels of a host as a set, made once for the hosts seen last."""

    def __init__(self, most: int = 2000):
        self.known: dict[str, frozenset[str]] = {}
        self.most = most

    def __call__(self, host: str, labels: pa.Scalar) -> frozenset[str]:
        if host not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[host] = frozenset(labels.as_py() or ())
        return self.known[host]


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, place, chars, slot, constant, differ) of a table (host, html, ordered): the whole wrappers, one row per place.

    ``slot`` tells that the text differs, ``constant`` is the hash of one that does not, ``differ`` counts pages, up to _DIFFER.
    """
    fields = {"host": pa.string(), "place": pa.string(), "chars": pa.int64(), "slot": pa.bool_(), "constant": pa.int64(), "differ": pa.list_(pa.int64())}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(h, p, x[2], x[3] is False, _signed(x[3]), x[4]) for h, w in known.items() for p, x in w.places.items()]
            known.clear()
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), fields.values(), strict=True)], list(fields))

        held, ordered = 0, _Ordered()
        for b in batches:
            for host, html, labels in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                wrapper = known.setdefault(host, Wrapper())
                held -= len(wrapper.places)
                wrapper.align(*read_page(html.as_py(), ordered(host, labels)))
                held += len(wrapper.places)
                if held > _PLACES:
                    yield from out()
                    held = 0
        yield from out()

    rows = pages.mapInArrow(partial, "host string, place string, chars long, slot boolean, constant long, differ array<long>")
    merged = rows.groupBy("host", "place").agg(
        F.sum("chars").alias("chars"),
        (F.max("slot") | F.coalesce(F.min("constant") != F.max("constant"), F.lit(False))).alias("slot"),
        F.min("constant").alias("constant"),
        F.least(F.size(F.array_distinct(F.flatten(F.collect_list("differ")))), F.lit(_DIFFER)).alias("differ"),
    )
    return merged.withColumn("constant", F.when(~F.col("slot"), F.col("constant")))


def _signed(slot: int | bool | None) -> int | None:
    return None if slot is None or slot is False else slot - (slot >> 63 << 64)


def host_decisions(wrappers: DataFrame) -> DataFrame:
    """(host, main, same): Wrapper.decisions() of each host, same as an array of (place, constant, inside as well)."""
    hosts = wrappers.groupBy("host").agg(
        F.sum("chars").alias("everything"),
        F.sum(F.when(F.col("slot") | (F.col("differ") < 3), F.col("chars")).otherwise(0)).alias("varies"),
    )
    hosts = materialize(hosts, "wrapper-hosts")
    texts = wrappers.where("chars > 0").join(hosts.select("host", "everything", "varies"), "host")
    parts = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rest = texts.where("place <> '' and (slot or differ < 3)").select("host", F.explode(above).alias("place"), "chars").groupBy("host", "place").agg(F.sum("chars").alias("chars"))
    rest = materialize(rest, "wrapper-rest")
    whole = rest.groupBy("host").agg(F.max("chars").alias("whole"))
    tag = F.regexp_extract("place", r"([^/.]*)[^/]*$", 1)
    main = rest.join(whole, "host").where((F.col("chars") >= 0.8 * F.col("whole")) & ~tag.isin("p", "li", "h1", "h2"))
    main = main.groupBy("host").agg(F.max(F.struct(F.char_length("place").alias("n"), "place")).getField("place").alias("main"))
    same = texts.where("constant is not null and differ >= 3 and varies >= 0.5 * everything")
    same = same.groupBy("host").agg(F.collect_list(F.struct("place", "constant", (F.col("differ") >= 5).alias("inside"))).alias("same"))
    return hosts.select("host").join(main, "host", "left").join(same, "host", "left").select("host", F.coalesce("main", F.lit("")).alias("main"), "same")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        page_host(F.col("url").cast("string")).alias("host"),
        text_or_empty("html").alias("html"),
    )
    ordered = materialize(ordered_labels(rows.select("host", "html")), "wrapper-order")  # a table, so that the join can split a hot host
    wrappers = materialize(infer_wrappers(rows.join(ordered, "host", "left").select("host", "html", "ordered")), "wrappers")
    decided = host_decisions(wrappers).join(ordered, "host", "left")
    decided = materialize(decided, "wrapper-decisions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        ordered = _Ordered()
        for b in batches:
            out = []
            for host, html, main, same, labels in zip(b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5), b.column(6), strict=True):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    rows = [(x["place"], x["constant"] % (1 << 64), x["inside"]) for x in same.as_py() or ()]
                    known[host] = main.as_py(), {p: h for p, h, _ in rows}, {p: h for p, h, inside in rows if inside}
                out.append(main_text(html.as_py(), known[host], ordered(host, labels)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    judged = rows.join(decided, "host").select("page_id", "url", "host", "html", "main", "same", "ordered")
    texts = judged.mapInArrow(run, "page_id long, url string, text string")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

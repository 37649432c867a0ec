"""Main text of web pages by wrappers inferred from all pages of a host.

A wrapper is a union-free regular expression over a page's tags, kept as a tree: each element has its
children in order, and every child is required, optional, repeated or both. Where siblings repeat they
are aligned with each other and become one repeated child; where the order of different siblings
changes, they become a repeated group of optional ones. Aligning the wrapper of some pages with the
wrapper of others works the same way: matched children are merged, the rest become optional. Text is a
slot that knows how much it held and whether it was always the same.

Pages are folded into wrappers where they are read, one per host and task; these meet in two levels of
a tree, so that a host with a large share of all pages is no single task's work. From the wrapper of
its host each page learns which element holds the article, and which texts are the template's own.
"""

from __future__ import annotations

import html as markup
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import map_texts, reachable, slices, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var".split()
)
# an element of the key ends open elements of its set
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea svg canvas object head title menu dialog".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor sponsored subscribe widget".split()
)
# words that name furniture only if the wrapper doesn't show varying text with few links there
DOUBTFUL_WORDS = frozenset("banner header menu respond share sharing social widget".split())
COMMENT_WORDS = frozenset(("comment", "comments", "disqus"))
CONTENT = frozenset(("article", "main"))
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
SIGN = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
# generated names differ in letters and digits; a run that has a digit is evened out
DIGITS = re.compile(r"[a-z]*[0-9][a-z0-9]*")
WORDS = re.compile(r"[a-z]+")
MAX_DEPTH = 48
# an element with more different children has those of one tag folded into one, if they are over FOLDED
WIDEST, FOLDED = 64, 8
HOSTS_HELD = 2_000
SALTS = 32
MAIN_SHARE = 0.6

Event = tuple[str, str, str]


def named_words(name: str, attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role that may name furniture."""
    if "=" not in attributes or name in ("html", "body"):
        return frozenset()
    return DROPPED_WORDS.intersection(w for _, v in SIGN.findall(attributes) for w in WORDS.findall(v.lower()))


def signature(name: str, attributes: str) -> str:
    """Name with class and id, generated names evened out."""
    sign = name
    for key, value in SIGN.findall(attributes) if "=" in attributes else ():
        value = DIGITS.sub("0", value.strip("\"'").lower())
        sign += {"class": ".", "id": "#", "role": "@"}[key.lower()] + " ".join(value.split())
    return sign


def events(page: str) -> Iterator[Event]:
    """("open", name, attributes), ("close", name, ""), ("text", text, "") and ("void", name, "").

    Comments, declarations and the contents of scripts and styles are gone; every element is closed,
    also those whose end the page leaves out, and ends of elements that aren't open are ignored.
    """
    stack: list[str] = []
    still_open: Counter[str] = Counter()
    at, size = 0, len(page)

    def close(name: str) -> Iterator[Event]:
        while stack:
            top = stack.pop()
            still_open[top] -= 1
            yield ("close", top, "")
            if top == name:
                return

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield ("text", page[at:], "")
            break
        if begin > at:
            yield ("text", page[at:begin], "")
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        tag = TAG.match(page, begin)
        if not tag:
            if begin + 1 < size and page[begin + 1] in "!?/" or page[begin + 1 : begin + 2].isalpha():
                end = page.find(">", begin)
                at = size if end < 0 else end + 1
            else:
                yield ("text", "<", "")
                at = begin + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if still_open[name]:
                yield from close(name)
            continue
        if name in ENDS_P and still_open["p"]:
            yield from close("p")
        for other in ENDS.get(name, ()):
            if stack and stack[-1] == other:
                yield from close(other)
        if name in VOID:
            yield ("void", name, "")
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        else:
            stack.append(name)
            still_open[name] += 1
            yield ("open", name, tag[3])
    if stack:
        yield from close("")


# --- wrappers: [signature, required, repeated, chars, constant text or None, grouped, children,
# --- pages that held it, chars of links, words that may name furniture] -----------------------------

SIGN_, NEEDED, MANY, CHARS, SAME, GROUPED, CHILDREN, PAGES, LINKS, WORDS_ = range(10)


def node(sign: str, words: frozenset[str] = frozenset()) -> list:
    return [sign, True, False, 0, "", False, [], 1, 0, sorted(words)]


def narrowed(children: list[list]) -> list[list]:
    """Children of bounded number: many different ones of one tag become one repeated, optional child."""
    if len(children) <= WIDEST:
        return children
    tag = lambda c: re.split(r"[.#@*]", c[SIGN_], maxsplit=1)[0]
    many = {t for t, n in Counter(map(tag, children)).items() if n > FOLDED}
    out: list[list] = []
    folded: dict[str, list] = {}
    for child in children:
        t = tag(child)
        if t not in many:
            out.append(child)
        elif t in folded:
            folded[t][:] = align(folded[t], child, within=True)
            folded[t][NEEDED], folded[t][MANY] = False, True
        else:
            folded[t] = [f"{t}*", False, True, *child[CHARS:]]
            out.append(folded[t])
    return out


def align(a: list, b: list, within: bool = False) -> list:
    """The wrapper that matches what either of two wrappers of the same element matches.

    ``within`` one page, the element repeats; otherwise the wrappers are of different pages.
    """
    out = [
        a[SIGN_],
        a[NEEDED] and b[NEEDED],
        a[MANY] or b[MANY],
        a[CHARS] + b[CHARS],
        a[SAME] if a[SAME] == b[SAME] else None,
        a[GROUPED] or b[GROUPED],
        [],
        max(a[PAGES], b[PAGES]) if within else a[PAGES] + b[PAGES],
        a[LINKS] + b[LINKS],
        sorted({*a[WORDS_], *b[WORDS_]}),
    ]
    theirs = {c[SIGN_]: (i, c) for i, c in enumerate(b[CHILDREN])}
    merged: list[list] = []
    used, last = set(), -1
    for child in a[CHILDREN]:
        found = theirs.get(child[SIGN_])
        if found is None:
            merged.append([child[SIGN_], False, *child[MANY:]])
            continue
        place, other = found
        if place < last:
            out[GROUPED] = True  # the order changes: a repeated group of optional elements
        # what the other side has before the match comes before it here, optional
        for extra in b[CHILDREN][last + 1 : place]:
            if extra[SIGN_] not in used and not any(extra[SIGN_] == c[SIGN_] for c in a[CHILDREN]):
                merged.append([extra[SIGN_], False, *extra[MANY:]])
                used.add(extra[SIGN_])
        merged.append(align(child, other, within))
        used.add(child[SIGN_])
        last = max(last, place)
    merged += [[c[SIGN_], False, *c[MANY:]] for c in b[CHILDREN] if c[SIGN_] not in used]
    out[CHILDREN] = narrowed(merged)
    return out


def add_child(parent: list, child: list) -> None:
    """Append a child; a sibling with its signature takes it in as a repetition."""
    for i, c in enumerate(parent[CHILDREN]):
        if c[SIGN_] == child[SIGN_]:
            if i < len(parent[CHILDREN]) - 1:
                parent[GROUPED] = True
            both = align(c, child, within=True)
            both[NEEDED], both[MANY] = True, True
            parent[CHILDREN][i] = both
            return
    parent[CHILDREN].append(child)
    parent[CHILDREN] = narrowed(parent[CHILDREN])


def page_wrapper(page: str) -> list:
    """The wrapper of one page: its elements, without inline ones, repetitions folded."""
    stack = [node("")]
    names, links = [""], 0
    for kind, name, value in events(page):
        if kind == "open":
            names.append(name)
            inside = name not in INLINE and len(stack) <= MAX_DEPTH
            stack.append(node(signature(name, value), named_words(name, value)) if inside else stack[-1])
            links += name == "a"
        elif kind == "close":
            links -= names.pop() == "a"
            done = stack.pop()
            if done is not stack[-1]:
                add_child(stack[-1], done)
        elif kind == "text" and (text := " ".join(name.split())):
            slot = stack[-1]
            slot[SAME] = text if not slot[CHARS] else (slot[SAME] if slot[SAME] == text else None)
            slot[CHARS] += len(text)
            slot[LINKS] += len(text) if links else 0
    return stack[0]


def main_path(wrapper: list) -> tuple[str, list[str], list[str]]:
    """Path of the element that holds the article, paths of template text, and paths that aren't furniture.

    A text is the template's if several pages held it and it was always the same. Elements whose names
    speak of furniture are taken for it, except where the wrapper shows otherwise: doubtful names with
    text that varies from page to page and is mostly no links, and whatever holds most of the text that
    varies, unless it is named as comments.
    """
    constant: list[str] = []
    kept: list[str] = []
    masses: dict[str, int] = {}

    def tag_of(n: list) -> str:
        return re.split(r"[.#@*]", n[SIGN_], maxsplit=1)[0]

    def varying(n: list) -> int:
        return n[CHARS] if n[SAME] is None or n[PAGES] < 2 else 0

    def summed(n: list) -> tuple[int, int, int]:
        """(varying characters, characters, characters of links) below an element, tags of furniture left out."""
        if tag_of(n) in DROPPED or not COMMENT_WORDS.isdisjoint(n[WORDS_]):
            return 0, 0, 0
        parts = [summed(c) for c in n[CHILDREN]]
        return tuple(own + sum(p[i] for p in parts) for i, own in enumerate((varying(n), n[CHARS], n[LINKS])))

    whole = summed(wrapper)[0]

    def is_furniture(n: list) -> bool:
        if tag_of(n) in DROPPED:
            return True
        words = set(n[WORDS_])
        if not words:
            return False
        changing, chars, links = summed(n)
        if 2 * changing > whole > 0:
            return False
        return not (words <= DOUBTFUL_WORDS and n[PAGES] > 1 and changing > 0 and 2 * links < chars)

    def walk(n: list, path: str) -> tuple[int, str | None, int]:
        """(characters that vary, path of an article, its characters)"""
        if path and is_furniture(n):
            return 0, None, 0
        if n[WORDS_]:
            kept.append(path)
        own = varying(n)
        if n[CHARS] and n[SAME] and n[PAGES] > 1:
            constant.append(path)
        best: tuple[str | None, int] = (None, -1)
        for child in n[CHILDREN]:
            chars, found, held = walk(child, f"{path}/{child[SIGN_]}")
            own += chars
            if found is not None and held > best[1]:
                best = (found, held)
        if (tag_of(n) in CONTENT or "@main" in n[SIGN_]) and own > best[1]:
            best = (path, own)
        masses[path] = own
        return own, best[0], best[1]

    total, article, _ = walk(wrapper, "")
    if article is None:
        # the deepest element with most of the text that varies
        deep = [p for p, m in masses.items() if m >= MAIN_SHARE * total > 0]
        container = [p for p in deep if not re.match(r"(p|h[1-6]|li|tr|td|th)\b", p.rsplit("/", 1)[-1])]
        article = max(container, key=lambda p: (p.count("/"), p), default="")
    return article, constant, kept


def extract(page: str | None, path: str, constant: frozenset[str], kept: frozenset[str] = frozenset()) -> str:
    """Main text of a page, given where its host's wrapper has the article."""
    blocks, anywhere = _blocks(page or "", path, frozenset(), kept)
    if not anywhere:
        blocks, anywhere = _blocks(page or "", None, frozenset(), kept)
    if not anywhere:
        blocks, _ = _blocks(page or "", "", constant, kept)
    return "\n".join(blocks)


def _blocks(page: str, path: str | None, constant: frozenset[str], kept: frozenset[str]) -> tuple[list[str], bool]:
    """Text blocks of the elements at ``path`` (None: of any article), and whether there were any."""
    blocks: list[str] = []
    run: list[str] = []
    signs = [""]
    inside = 1 if path == "" else 0  # depth at which the article began
    out_at, found = 0, path == ""

    def end_block() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append(text)
            run.clear()

    for kind, name, value in events(page):
        if kind == "open":
            inline = name in INLINE or len(signs) > MAX_DEPTH
            sign = signature(name, value)
            signs.append(signs[-1] if inline else f"{signs[-1]}/{sign}")
            words = named_words(name, value)
            # an inline element is no slot of the wrapper; within a sentence a doubtful name isn't enough
            known = words <= DOUBTFUL_WORDS if inline else signs[-1] in kept
            left_out = name in DROPPED or bool(words) and not known
            if name not in INLINE:
                end_block()
            if left_out and not out_at:
                out_at = len(signs)
            elif not inside and not out_at:
                if name in CONTENT or "@main" in sign if path is None else signs[-1] == path and not inline:
                    inside, found = len(signs), True
        elif kind == "close":
            if name not in INLINE:
                end_block()
            if out_at == len(signs):
                out_at = 0
            if inside == len(signs):
                inside = 0
            signs.pop()
        elif inside and not out_at:
            if kind == "void":
                run.append(" ") if name == "br" else end_block()
            elif not constant or signs[-1] not in constant:
                run.append(markup.unescape(name))
    end_block()
    return blocks, found


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper, as JSON, of all pages (host, html) of each host."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for host, page in zip(part["host"].to_pylist(), part["html"].to_pylist()):
                    if page:
                        new = page_wrapper(page)
                        held[host] = align(held[host], new) if host in held else new
                if len(held) > HOSTS_HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
            names=["host", "wrapper"],
        )

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for text in batch["wrapper"].to_pylist():
                whole = align(whole, json.loads(text)) if whole else json.loads(text)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([json.dumps(whole)])], names=["host", "wrapper"])

    parts = reachable(pages).select("host", "html").mapInArrow(fold, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInArrow(meet, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(meet, "host string, wrapper string")


def main_texts(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``df``.

    One row per row, repeated pages included. NULL or empty html, and a page of nothing but furniture,
    give an empty text; pages without a readable host share one wrapper. An empty table gives an empty
    result; other columns are ignored.
    """
    pages = df.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{url_column}`").alias("url"),
        host_of(F.col(f"`{url_column}`")).alias("host"),
        F.col(f"`{html_column}`").alias("html"),
    )

    def choose(batch: pa.RecordBatch) -> list[dict]:
        out = []
        for host, text in zip(batch["host"].to_pylist(), batch["wrapper"].to_pylist()):
            path, constant, kept = main_path(json.loads(text))
            out.append({"w_host": host, "path": path, "constant": constant, "kept": kept})
        return out

    # one short row per host; the planner sees its size
    places = written(map_texts(infer_wrappers(pages), "wrapper", choose, "w_host string, path string, constant array<string>, kept array<string>"))
    known = pages.join(places, F.col("host") == F.col("w_host"), "left").select("id", "url", "html", "path", "constant", "kept")
    kind = known.schema["id"].dataType.simpleString()

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            extract(page, path or "", frozenset(constant or ()), frozenset(kept or ()))
            for page, path, constant, kept in zip(*(batch[c].to_pylist() for c in ("html", "path", "constant", "kept")))
        ]
        return pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string())], names=["id", "url", "text"])

    done = map_texts(known, "html", body, f"id {kind}, url string, text string")
    return done.select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars")
    )

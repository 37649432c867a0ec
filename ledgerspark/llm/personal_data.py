"""Personal data: fixed patterns, and terms that give protected entities away.

Every e-mail address, network address, card and phone number is a protected entity. Words around a
mention are counted with it over the whole corpus. For entity c and term t

    PMI(c; t) = log2(p(c | t) / p(c)),    IC(c) = -log2 p(c),    disclosure = PMI / IC,

where p(c) is the share of word positions near a mention of c and p(c | t) the share of t's
positions that are. A term with a disclosure of 1 occurs nowhere but near c and names it as surely as
c itself. Near a mention of c, terms above the upper threshold are removed and those above the lower
one generalised.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerspark.llm.common import WORD, Span, joined, map_texts, ordered, reachable, sha256, slices, written
from ledgerspark.llm.secret_scan import span_text

# The base kinds and their patterns.
KINDS = ("email", "ip", "card", "phone", "reveals", "hints")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "hints": "[TERM]", "reveals": ""}
REACH = 64
MIN_JOINT = 3
REMOVE_AT, GENERALISE_AT = 0.99, 0.96
STRIPPED = ".,;:!?()[]{}<>|\"'*#%$&=+-_/\\"
MIN_TERM = 3
COUNTED = 250_000
ASCII_SPACE = " \t\n\v\f\r"

SCHEMA = (
    "id {id}, text_hash bigint, n_words bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "base array<struct<start:int,rank:int,end:int>>, "
    "near array<struct<entity:bigint,term:string,start:int,end:int>>"
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # each "@" once: its local part reaches back to the last match at most
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    # a dotted run is read four parts at a time
    for run in DOTTED.finditer(text):
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in four):
                yield at, at + length
            at += length + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind, without the matches that fail."""
    spans: list[Span] = [("email", s, e) for s, e in _emails(text)]
    spans += [("ip", s, e) for s, e in _addresses(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return ordered(spans, KINDS)


def entity_of(kind: str, value: str) -> int:
    """A signed 64-bit name of an entity that doesn't repeat its value."""
    value = value.lower() if kind in ("email", "ip") else _digits(value)
    n = xxhash.xxh64_intdigest(f"{kind}:{value}", 0)
    return n - (1 << 64) if n >> 63 else n


def term_of(word: str) -> tuple[str, int]:
    """The counted form of a word and how many characters its left end loses; empty if too short."""
    bare = word.strip(STRIPPED)
    if len(bare) < MIN_TERM:
        return "", 0
    return bare.lower(), len(word) - len(word.lstrip(STRIPPED))


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans cover, in order and apart."""
    begins: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)
    return begins, ends


def terms_near(text: str, spans: list[Span], reach: int = REACH) -> list[dict]:
    """Terms of the whole words within ``reach`` code points of a mention, once per entity and place.

    A word that a span touches is no term; the stretches that spans cover are searched by bisection, so
    a text of very many mentions takes time in proportion.
    """
    begins, ends = merged(spans)

    def touched(start: int, end: int) -> bool:
        i = bisect_right(ends, start)
        return i < len(begins) and begins[i] < end

    seen, out = set(), []
    for kind, start, end in spans:
        entity = entity_of(kind, text[start:end])
        left, right = max(0, start - reach), min(len(text), end + reach)
        for m in WORD.finditer(text, left, right):
            cut_off = (m.start() == left > 0 and text[left - 1] not in ASCII_SPACE) or (
                m.end() == right < len(text) and text[right] not in ASCII_SPACE
            )
            term, skipped = ("", 0) if cut_off else term_of(m[0])
            at = m.start() + skipped
            if not term or (entity, at) in seen:
                continue
            stop = at + len(m[0].strip(STRIPPED))
            if touched(m.start(), m.end()):
                continue
            seen.add((entity, at))
            out.append({"entity": entity, "term": term, "start": at, "end": stop})
    return out


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base spans of every text and the terms near them, one row per row of ``df``."""

    def body(batch: pa.RecordBatch) -> list[dict]:
        rows = []
        for key, text, digest in zip(*(batch[c].to_pylist() for c in ("id", "text", "text_hash"))):
            text = text or ""
            spans = base_spans(text)
            kinds = [s[0] for s in spans]
            rows.append(
                {
                    "id": key,
                    "text_hash": digest,
                    "n_words": len(text.encode().split()),
                    **{f"n_{kind}": kinds.count(kind) for kind in KINDS[:4]},
                    "base_sha256": sha256(joined(spans)),
                    "base": [{"start": s, "rank": KINDS.index(k), "end": e} for k, s, e in spans],
                    "near": terms_near(text, spans),
                }
            )
        return rows

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    return map_texts(source, "text", body, SCHEMA.format(id=source.schema["id"].dataType.simpleString()))


def term_counts(df: DataFrame, text_column: str = "text") -> DataFrame:
    """(term, n_term): how often each term occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part["text"].to_pylist():
                    # ASCII white space parts words, as in WORD
                    words.update((text or "").encode().split())
                    if len(words) > COUNTED:
                        yield flushed(words)
                        words = Counter()
        yield flushed(words)

    def flushed(words: Counter[bytes]) -> pa.RecordBatch:
        terms: Counter[str] = Counter()
        for word, n in words.items():
            terms[term_of(word.decode())[0]] += n
        terms.pop("", None)
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(terms.values(), pa.int64())], names=["term", "n"]
        )

    counted = reachable(df.select(F.col(text_column).alias("text"))).mapInArrow(run, "term string, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_pairs(
    scanned: DataFrame,
    counts: DataFrame,
    min_joint: int = MIN_JOINT,
    remove_at: float = REMOVE_AT,
    generalise_at: float = GENERALISE_AT,
) -> DataFrame:
    """(entity, term, rank): pairs whose disclosure reaches a threshold."""
    n_words = scanned.agg(F.sum("n_words")).first()[0] or 0
    near = scanned.select(F.explode("near").alias("n")).select("n.entity", "n.term")
    joint = written(near.groupBy("entity", "term").agg(F.count("*").alias("n_joint")))
    around = joint.groupBy("entity").agg(F.sum("n_joint").alias("n_entity"))
    pairs = joint.filter(F.col("n_joint") >= min_joint).join(around, "entity").join(counts, "term")
    information = F.log2(n_words / F.col("n_entity"))
    share = F.least(F.col("n_joint") / F.col("n_term"), F.lit(1.0))
    disclosure = 1 + F.log2(share) / information
    return pairs.filter((F.col("n_entity") < n_words) & (disclosure >= generalise_at)).select(
        "entity", "term", F.when(disclosure >= remove_at, 4).otherwise(5).alias("rank")
    )


def _added(scanned: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, added): spans of disclosing terms; a document's own mentions bound the group."""
    near = scanned.select(*keys, F.explode("near").alias("n")).select(*keys, "n.*")
    span = F.struct("start", "rank", "end")
    return near.join(pairs, ["entity", "term"]).groupBy(*keys).agg(F.collect_set(span).alias("added"))


def find_personal_data(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **thresholds: float
) -> DataFrame:
    """Spans of every text: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_reveals, n_hints).

    One row per row of ``df``, repeated rows included; a NULL text counts as empty; an empty table
    gives an empty result; other columns are ignored. A term near two entities takes the stricter
    span of the two and keeps the other.
    """
    scanned = written(scan(df, id_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    pairs = written(disclosing_pairs(scanned, term_counts(df, text_column), **thresholds))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    joined_rows = scanned.join(_added(scanned, pairs, "row"), "row", "left").withColumn(
        "added", F.coalesce("added", none)
    )
    number = lambda rank: F.size(F.filter("added", lambda a: a["rank"] == rank)).cast("long")
    return joined_rows.select(
        F.col("id").alias(id_column),
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        "base_sha256",
        span_text(F.concat("base", "added"), KINDS).alias("spans"),
        number(4).alias("n_reveals"),
        number(5).alias("n_hints"),
    )


def masked(text: str, spans: list[Span], masks: dict[str, str] = MASKS) -> str:
    """Replace spans from left to right; a span that begins inside a replaced one only prolongs it."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], masks[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **thresholds: float) -> DataFrame:
    """``df`` with personal data replaced in its texts: masks for entities and hints, nothing for
    terms that reveal one.

    All rows and columns stay; a NULL text stays NULL; texts without personal data are unchanged.
    """
    scanned = written(scan(df, id_column, text_column))
    pairs = written(disclosing_pairs(scanned, term_counts(df, text_column), **thresholds))
    hit = scanned.filter(F.size("near") > 0).dropDuplicates(["id", "text_hash"])
    # a table of its own, so that the planner sees how small it is beside the texts
    added = written(_added(hit, pairs, "id", "text_hash"))
    others = [c for c in df.columns if c != text_column]
    held = df.select(
        F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"_{c}") for c in others]).alias("doc"),
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    same = held["id"].eqNullSafe(added["id"]) & (held["text_hash"] == added["text_hash"])
    rows = held.join(added, same, "left").select("doc", "text", "added")

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, extra in zip(batch["text"].to_pylist(), batch["added"].to_pylist()):
            if text:
                spans = base_spans(text) + [(KINDS[a["rank"]], a["start"], a["end"]) for a in extra or ()]
                text = masked(text, ordered(spans, KINDS)) if spans else text
            texts.append(text)
        return pa.RecordBatch.from_arrays([batch["doc"], pa.array(texts, pa.string())], names=["doc", "text"])

    done = map_texts(rows, "text", body, StructType([rows.schema["doc"], rows.schema["text"]]))
    return done.select(
        *[F.col("text").alias(c) if c == text_column else F.col(f"doc.`_{c}`").alias(c) for c in df.columns]
    )

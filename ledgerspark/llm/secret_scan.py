"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control.

Every run of 16 or more key characters is a candidate, or its parts between the characters that join
words and paths if no alphabet holds the whole or the whole looks plain. Its encoding is inferred from the characters it
uses; under "each symbol is drawn uniformly from that alphabet" three tests give p-values: chi-squared
uniformity, runs about the middle of the alphabet, and lag-one serial correlation. The smallest,
times three, is the candidate's p-value. Within each length class the Benjamini-Hochberg procedure
over the whole corpus rejects randomness at a given false-discovery rate; what it can't reject is
reported. Classes keep short runs, on which the tests are weak, from setting the threshold of long
ones.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Span, joined, map_texts, ordered, sha256, written

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 8, 16

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile(r"[A-Za-z0-9]{16,}")
# a run whose own p-value is lower than this is looked at by its parts
PLAIN = 0.01
HEX_DIGITS = "0123456789abcdef"
ALPHABETS = {
    "hex": HEX_DIGITS,
    "HEX": HEX_DIGITS.upper(),
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
_SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
_UPPER, _LOWER = frozenset(string.ascii_uppercase), frozenset(string.ascii_lowercase)
_INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
BINS_PER_DECADE, BINS = 20, 400

SCHEMA = (
    "id {id}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "base array<struct<start:int,rank:int,end:int>>, "
    "found array<struct<start:int,rank:int,end:int,length_class:int,bin:int>>"
)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind."""
    spans: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(spans, KINDS)


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run; None for plain numbers and letters of one case."""
    symbols = frozenset(run)
    if symbols <= frozenset(string.digits):
        return None
    if not symbols & frozenset(string.digits) and not (symbols & _UPPER and symbols & _LOWER):
        return None
    return next((name for name, letters in _SETS.items() if symbols <= letters), None)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(ranks: np.ndarray, size: int) -> float:
    """Uniformity over equal slices of the alphabet, five expected symbols in each at least."""
    slices = max(2, min(size, len(ranks) // 5))
    edges = np.linspace(0, size, slices + 1).round().astype(int)
    counts = np.histogram(ranks, bins=edges - 0.5)[0]
    expected = len(ranks) * np.diff(edges) / size
    statistic, freedom = float(((counts - expected) ** 2 / expected).sum()), slices - 1
    # Wilson and Hilferty's normal approximation of the upper tail
    spread = 2 / (9 * freedom)
    z = ((statistic / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(ranks: np.ndarray, size: int) -> float:
    """Wald and Wolfowitz's runs above and below the middle of the alphabet."""
    high = ranks * 2 >= size
    n, above = len(ranks), int(high.sum())
    below = n - above
    if not above or not below:
        return 2.0 ** (1 - min(n, 1000))
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * above * below / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(ranks: np.ndarray) -> float:
    """Correlation of each symbol with the next one."""
    x = ranks - ranks.mean()
    power = float((x * x).sum())
    if power == 0:
        return 0.0
    n = len(ranks)
    r = float((x[1:] * x[:-1]).sum()) / power
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def randomness_p(run: str, encoding: str) -> float:
    """p-value of the battery for one run; small where the run isn't random."""
    index, size = _INDEX[encoding], len(ALPHABETS[encoding])
    ranks = np.array([index[c] for c in run], dtype=float)
    return min(1.0, 3 * min(chi_squared_p(ranks, size), runs_p(ranks, size), serial_p(ranks)))


def length_class(length: int) -> int:
    return length.bit_length()


def p_bin(p: float) -> int:
    """Bin b holds p-values up to 10 ** (-b / BINS_PER_DECADE), its upper edge."""
    return BINS if p <= 0 else min(BINS, int(-math.log10(p) * BINS_PER_DECADE))


def _free(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether no span touches a stretch of text, asked from left to right."""
    ends = sorted((s, e) for _, s, e in spans)
    at = 0

    def free(start: int, end: int) -> bool:
        nonlocal at
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        # spans of different kinds may overlap, so those begun before the end are looked at in turn
        i = at
        while i < len(ends) and ends[i][0] < end:
            if ends[i][1] > start:
                return False
            i += 1
        return True

    return free


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int, int, float]]:
    """(start, end, length, p) of the runs that no base span touches.

    A run that one alphabet holds and that doesn't look plain at once is tested as a whole. Any other is
    parted at the characters that join words and paths, and its long enough parts are tested.
    """
    out = []
    free = _free(taken)
    for m in CANDIDATE.finditer(text):
        run = m[0].rstrip("=")
        if not free(m.start(), m.end()):
            continue
        encoding = infer_encoding(run)
        p = randomness_p(run, encoding) if encoding else 0.0
        parts = list(PART.finditer(run))
        whole = len(parts) == 1 and len(parts[0][0]) == len(run)
        if encoding and (whole or p >= PLAIN):
            out.append((m.start(), m.end(), len(run), p))
            continue
        for part in parts:
            if encoding := infer_encoding(part[0]):
                out.append((m.start() + part.start(), m.start() + part.end(), len(part[0]), randomness_p(part[0], encoding)))
    return out


def rejection_bins(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Per length class the first bin that Benjamini-Hochberg rejects (BINS + 1 where none)."""
    cuts = {}
    for cls in {c for c, _ in counts}:
        total = sum(n for (c, _), n in counts.items() if c == cls)
        cuts[cls] = BINS + 1
        at_most = 0
        for b in range(BINS, -1, -1):
            at_most += counts.get((cls, b), 0)
            edge = 10 ** (-b / BINS_PER_DECADE) if b < BINS else 0.0
            if at_most and total * edge <= rate * at_most:
                cuts[cls] = b
    return cuts


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base spans and tested candidates of every text, one row per row of ``df``."""

    def body(batch: pa.RecordBatch) -> list[dict]:
        rows = []
        for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            text = text or ""
            spans = base_spans(text)
            kinds = [s[0] for s in spans]
            found = []
            for start, end, length, p in candidates(text, spans):
                found.append({"start": start, "rank": 3, "end": end, "length_class": length_class(length), "bin": p_bin(p)})
            rows.append(
                {
                    "id": key,
                    "n_assign": kinds.count("assign"),
                    "n_access": kinds.count("access"),
                    "n_hex": kinds.count("hex"),
                    "base_sha256": sha256(joined(spans)),
                    "base": [{"start": s, "rank": KINDS.index(k), "end": e} for k, s, e in spans],
                    "found": found,
                }
            )
        return rows

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_texts(source, "text", body, SCHEMA.format(id=source.schema["id"].dataType.simpleString()))


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of structs (start, rank, end), ordered and joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_secrets(
    df: DataFrame, false_discovery_rate: float = 0.05, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Secrets of every text: (id, n_assign, n_access, n_hex, base_sha256, spans, n_random).

    Spans of kind ``random`` are those the battery adds; base spans stay. One row per row of ``df``,
    repeated rows included; a NULL text counts as empty and has no spans; an empty table gives an
    empty result; other columns are ignored. Equal p-values are kept or rejected together.
    """
    scanned = written(scan(df, id_column, text_column))
    # at most one row per length class and bin reaches the driver
    counts = scanned.select(F.explode("found").alias("f")).groupBy("f.length_class", "f.bin").count().collect()
    cuts = rejection_bins({(r["length_class"], r["bin"]): r["count"] for r in counts}, false_discovery_rate)
    cut_of = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else None
    kept = (
        F.filter("found", lambda f: f["bin"] < F.element_at(cut_of, f["length_class"]))
        if cuts
        else F.slice("found", 1, 0)
    )
    added = F.transform(kept, lambda f: F.struct(f["start"], f["rank"], f["end"]))
    return scanned.select(
        F.col("id").alias(id_column),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        span_text(F.concat("base", added), KINDS).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )

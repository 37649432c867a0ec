"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated isotonically.

The features are densities of a weighted lexicon (in all, of its strong entries, in the densest
stretch, in disguised spelling), its nearness to second-person words, capitals, punctuation and rates
of obfuscated words. The lexicon, of words and word beginnings, is learned from labelled training rows
too: an entry's weight is its log odds to occur in toxic texts, and it enters if the odds are sure enough.
It is cross-fitted: training rows are dealt into folds, and the trees and the calibration see each row
through the lexicon of the other folds; new texts are read with the lexicon of all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerspark.llm.common import map_texts, reachable, uniform, written

TRAIN_ROWS = 24_000
FOLDS, TREE_SHARE = 5, 0.7
LEXICON_SIZE, MIN_TOXIC_DOCUMENTS, MIN_SURE_ODDS = 4_000, 3, 1.2
LEVELS_PER_UNIT, LEVELS = 4, 31
STRONG = 3.0
PREFIXES = (4, 5, 6)
PREDICT_AT = 0.7
DOUBTS = 2
REMEMBERED = 200_000
NEAR, STRETCH = 5, 50

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta vous votre vos tú ti usted ustedes vosotros tuyo".split()
)
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = ".,;:!?()[]{}<>|\"'*#%&=+-_/\\…“”„«»"
INSIDE = re.compile(r"[^\w]|_")
REPEATED = re.compile(r"(.)\1\1")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DISGUISED, SECOND, CAPITALS, OBFUSCATED, STRETCHED = 1, 2, 4, 8, 16
FEATURES = (
    "weight_density",
    "log_weight",
    "weight_per_root",
    "hit_density",
    "strong_density",
    "log_strong",
    "stretch_weight",
    "disguised_density",
    "near_second_person",
    "second_person_density",
    "capital_words",
    "capital_letters",
    "exclamations",
    "questions",
    "obfuscated_words",
    "stretched_words",
    "log_words",
)


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


def undisguised(word: str) -> str:
    """The word with look-alike digits and signs read as letters and inner separators gone."""
    return INSIDE.sub("", word.lower().rstrip(".,;:!?").translate(DISGUISES))


def entries(bare: str) -> list[str]:
    """The word and its beginnings, which are marked by a trailing star."""
    return [bare] + [bare[:n] + "*" for n in PREFIXES if len(bare) > n]


class WordCodes(dict):
    """Flags of each word, worked out once; forgotten when too many are held."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def level(self, bare: str) -> int:
        return max(self.lexicon.get(e, 0) for e in entries(bare))

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        bare, clear = plain(word), undisguised(word)
        level = self.level(bare)
        shown = not level and clear != bare and bool(self.level(clear))
        mixed = any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare)
        code = (
            (self.level(clear) if shown else level) << 8
            | DISGUISED * shown
            | SECOND * (bare in SECOND_PERSON)
            | CAPITALS * (len(bare) > 1 and word.isupper())
            | OBFUSCATED * (mixed or any(c in "*@$#" for c in bare))
            | STRETCHED * bool(REPEATED.search(bare))
        )
        self[word] = code
        return code


def features(text: str | None, codes: WordCodes) -> list[float]:
    """The dense features of one text, all 0 if it has no words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    flags = np.fromiter(map(codes.__getitem__, words), np.uint16, n)
    weights = (flags >> 8) / LEVELS_PER_UNIT
    hits = np.nonzero(weights)[0]
    second = np.nonzero(flags & SECOND)[0]
    near, stretch = 0, 0.0
    if len(hits):
        sums = np.concatenate([[0.0], np.cumsum(weights[hits])])
        stretch = float((sums[np.searchsorted(hits, hits + STRETCH)] - sums[:-1]).max())
        if len(second):
            at = np.searchsorted(second, hits)
            before = np.abs(hits - second[np.maximum(at - 1, 0)])
            after = np.abs(hits - second[np.minimum(at, len(second) - 1)])
            near = int((np.minimum(before, after) <= NEAR).sum())
    total, strong = float(weights.sum()), int(np.count_nonzero(weights >= STRONG))
    data = text.encode()
    share = lambda flag: float(np.count_nonzero(flags & flag)) / n
    return [
        total / n,
        math.log1p(total),
        total / math.sqrt(n),
        len(hits) / n,
        strong / n,
        math.log1p(strong),
        stretch,
        share(DISGUISED),
        near / max(1, len(hits)),
        len(second) / n,
        share(CAPITALS),
        (len(data) - len(data.translate(None, UPPER))) / len(data),
        data.count(b"!") / n,
        data.count(b"?") / n,
        share(OBFUSCATED),
        share(STRETCHED),
        math.log1p(n),
    ]


def in_fold(key: Column) -> Column:
    """Held out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class ToxicityModel:
    """A lexicon, trees and a calibration; without both classes in training a constant score."""

    lexicon: dict[str, int]
    trees: object | None
    calibration: object | None
    constant: float

    def score(self, df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(id, text_hash, score, predicted) of every row."""
        source = df.select(
            F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")
        ).withColumn("text_hash", F.xxhash64("text"))
        if self.trees is None:
            scored = source.withColumn("score", F.lit(self.constant))
        else:
            scored = self._calibrated(_featured(source, [self.lexicon], "id", "text_hash"))
        return scored.select(
            "id", "text_hash", "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted")
        )

    def _calibrated(self, rows: DataFrame) -> DataFrame:
        raw = _raw_scores(self.trees, rows)
        return self.calibration.transform(raw).withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
        )


def _raw_scores(trees, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows.withColumn("vector", array_to_vector("x")))
    return scored.withColumn("raw", vector_to_array("probability")[1])


def _with_features(rows: DataFrame, lexicon: dict[str, int], text: str) -> DataFrame:
    """``rows`` with the features of column ``text`` as array x."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON_SIZE entries at most
    state: dict[str, WordCodes] = {}

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = state.setdefault("codes", WordCodes(sent.value))
        x = pa.array([features(t, codes) for t in batch[text].to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, x], names=[*batch.schema.names, "x"])

    return map_texts(rows, text, body, StructType([*rows.schema.fields, StructField("x", ArrayType(DoubleType()))]))


def _featured(rows: DataFrame, lexicons: list[dict[str, int]], *keys: str) -> DataFrame:
    """``rows`` with the features as array x in place of the text; key fold, if any, picks the lexicon."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    sent = rows.sparkSession.sparkContext.broadcast(lexicons)  # LEXICON_SIZE entries each at most
    state: list[WordCodes] = []

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.extend(map(WordCodes, sent.value))
        fold = batch["fold"].to_pylist() if "fold" in keys else [0] * batch.num_rows
        x = [features(t, state[f]) for t, f in zip(batch["text"].to_pylist(), fold)]
        return pa.RecordBatch.from_arrays(
            [*(batch[k] for k in keys), pa.array(x, pa.list_(pa.float64()))], names=[*keys, "x"]
        )

    return map_texts(rows.select(*keys, "text"), "text", body, f"{kinds}, x array<double>")


def learn_lexicons(rows: DataFrame, folds: int = FOLDS, size: int = LEXICON_SIZE) -> list[dict[str, int]]:
    """Levels of the words and beginnings that training rows (text, label, fold) show more if they are toxic.

    One lexicon per fold, from the rows of the others, and last that of all rows. A level is the log odds
    of an occurrence times LEVELS_PER_UNIT; two standard errors of it, from the numbers of texts, are
    granted to chance. The rows are read once: a fold's counts are taken off the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times: dict[tuple[int, int], Counter] = defaultdict(Counter)
            texts: dict[tuple[int, int], Counter] = defaultdict(Counter)
            for text, label, fold in zip(*(batch[c].to_pylist() for c in ("text", "label", "fold"))):
                held = Counter()
                for word, n in Counter(map(plain, (text or "").split())).items():
                    for e in entries(word) if len(word) > 2 else ():
                        held[e] += n
                times[label, fold].update(held)
                texts[label, fold].update(held.keys())
            for (label, fold), counts in times.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(counts.keys(), pa.string()),
                        pa.array([label] * len(counts), pa.int32()),
                        pa.array([fold] * len(counts), pa.int32()),
                        pa.array(counts.values(), pa.int64()),
                        pa.array([texts[label, fold][e] for e in counts], pa.int64()),
                    ],
                    names=["entry", "label", "fold", "n", "texts"],
                )

    words = {
        (r["label"], r["fold"]): r["words"] or 0
        for r in rows.groupBy("label", "fold").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    }
    of = lambda column, label, fold: F.sum(
        F.when((F.col("label") == label) & (F.col("fold") == fold), F.col(column)).otherwise(0)
    )
    counted = (
        reachable(rows.select("text", "label", "fold"))
        .mapInArrow(run, "entry string, label int, fold int, n bigint, texts bigint")
        .groupBy("entry")
        .agg(
            *[of("n", label, k).alias(f"n{label}{k}") for label in (0, 1) for k in range(folds)],
            *[of("texts", label, k).alias(f"d{label}{k}") for label in (0, 1) for k in range(folds)],
        )
    )
    over = lambda name, left: sum((F.col(f"{name}{k}") for k in range(folds) if k != left), F.lit(0))
    counted = written(counted.filter(over("d1", None) >= MIN_TOXIC_DOCUMENTS))

    def lexicon(left: int | None) -> dict[str, int]:
        clean, toxic = (sum(n for (lab, k), n in words.items() if lab == label and k != left) for label in (0, 1))
        if toxic <= 0 or clean <= 0:
            return {}
        t, c, dt, dc = (over(name, left) for name in ("n1", "n0", "d1", "d0"))
        odds = F.log((t + 0.5) / toxic) - F.log((c + 0.5) / clean)
        seen = counted.select("entry", odds.alias("odds"), dt.alias("dt"), dc.alias("dc"))
        seen = seen.filter(F.col("dt") >= MIN_TOXIC_DOCUMENTS)
        sure = F.col("odds") - 2 * F.sqrt(1 / F.col("dt") + 1 / (F.col("dc") + 0.5))
        ranked = seen.filter(sure >= MIN_SURE_ODDS).orderBy(F.desc(F.col("dt") * F.col("odds")), "entry").limit(size)
        return {
            r["entry"]: min(LEVELS, max(1, round(r["odds"] * LEVELS_PER_UNIT)))
            for r in ranked.select("entry", "odds").collect()
        }

    return [lexicon(left) for left in (*range(folds), None)]


def train(
    df: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold, ``train_rows`` of them at most, chosen by hash.

    Of an id with several labels the highest counts; NULL ids and NULL labels are left out.
    """
    known = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IS NOT NULL")
        .filter(~in_fold(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    known = written(known)
    n = known.count()
    place = uniform(F.lit(3), F.col("id"))
    chosen = known.filter(place < min(1.0, train_rows / max(1, n))) if n > train_rows else known
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    # the chosen labels are bounded by train_rows
    rows = texts.join(F.broadcast(chosen), "id").withColumns(
        {
            "part": uniform(F.lit(5), F.col("id")),
            "fold": F.floor(uniform(F.lit(7), F.col("id")) * FOLDS).cast("int"),
        }
    )
    rows = written(rows)
    *others, lexicon = learn_lexicons(rows)
    seen = written(_featured(rows, others, "id", "label", "part", "fold").coalesce(4))
    grown, held = seen.filter(F.col("part") < TREE_SHARE), seen.filter(F.col("part") >= TREE_SHARE)
    both = lambda part: part.select("label").distinct().count() == 2
    if not both(grown) or not both(held):
        rate = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        return ToxicityModel(lexicon, None, None, float(rate))
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=1, maxBins=32
    ).fit(grown.withColumn("vector", array_to_vector("x")))
    raw = _raw_scores(trees, held).select("raw", F.col("label").cast("double").alias("label"))
    # the rule of succession: clean texts added at the top, as few labels can't make a sure verdict
    doubt = df.sparkSession.createDataFrame([(1.0, 0.0)] * DOUBTS, "raw double, label double")
    raw = raw.unionByName(doubt)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return ToxicityModel(lexicon, trees, calibration, 0.0)


def toxicity(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``df``.

    Scores depend on the text only. NULL and empty texts are scored like any text without words;
    repeated rows get equal scores; an empty table gives an empty result; labels of one class only,
    or none, give every text the share of toxic labels. Other columns are ignored.
    """
    model = train(df, labels, id_column=id_column, text_column=text_column, **options)
    return model.score(df, id_column, text_column).select(
        F.col("id").alias(id_column), in_fold(F.col("id")).alias("held_out"), "score", "predicted"
    )


def reject_toxic(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``df`` without the rows predicted toxic; all columns stay."""
    model = train(df, labels, id_column=id_column, text_column=text_column, **options)
    if model.trees is None:
        return df if model.constant < PREDICT_AT else df.limit(0)
    # rows pass through with their features, so texts are neither joined nor moved
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    featured = _with_features(rows, model.lexicon, names[df.columns.index(text_column)])
    kept = model._calibrated(featured).filter(F.col("score") < PREDICT_AT)
    return kept.select(*names).toDF(*df.columns)

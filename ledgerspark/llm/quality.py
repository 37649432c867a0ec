"""Quality rules: text statistics, and robust multivariate outliers per language and source.

Statistics are column expressions, so a text is read once and nothing but numbers leaves its row. Of
each language and source the minimum-covariance-determinant estimate is found from several fixed starts
(medians with spreads alone, with correlations of squashed values, and of spatial signs). A concentration
step takes mean and covariance of the closest half of the documents again, which never raises the
determinant; every start goes on until it falls no more, and the least determinant wins. As usual the
estimate is then taken once more from all documents that are no outliers to it. A document is rejected if
its Mahalanobis distance from its group's estimate is beyond a far quantile of the chi-squared
distribution.

Transformed statistics, each with a floor for its spread, so that a group in which nearly all texts
agree doesn't reject the rest for trifles: symbols per word, share of repeated lines, share of words in
repeated windows, and log mean word length drawn towards a prior in short texts.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.binding import bind
from ledgerspark.llm.common import SPACE, written

WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
PRIOR_WORDS, PRIOR_LENGTH = 50, 5.0
FLOORS = (0.05, 0.10, 0.08, 0.10)
# The core is the least of these shares that holds half of the group and (d + 1) / 2 more.
CORE_SHARES = (0.5, 0.501, 0.51, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0)
# Correlations of a start are shrunk, so that its covariance has an inverse.
SHRUNK = 0.95
# A logarithm of the determinant that falls by less has come to rest.
FALL = 1e-3
# Quantiles of the chi-squared distribution with four degrees of freedom: 0.5, 0.975 and 0.999.
CHI2_MEDIAN, CHI2_EDGE, CHI2_FAR = 3.357, 11.143, 18.467
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _window_hashes(words: Column) -> Column:
    """A hash of every run of WINDOW words, in text order."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def count(marked: Column) -> Column:
        places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
        each = lambda d: F.transform(
            d, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - p, F.lit(WINDOW)))
        )
        return bind(places, lambda d: F.aggregate(each(d), F.lit(0), lambda total, n: total + n))

    def mark(ordered: Column) -> Column:
        twin = lambda s, k: F.coalesce(F.get(ordered, k)["h"] == s["h"], F.lit(False))
        return F.transform(ordered, lambda s, k: F.when(twin(s, k - 1) | twin(s, k + 1), s["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = bind(ordered, lambda o: count(mark(o)))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated).otherwise(0)


def text_statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text; a NULL text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    counts = bind(words, lambda w: F.struct(F.size(w).alias("n"), bind(_window_hashes(w), _covered).alias("r")))
    line_counts = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return {
        "words": counts,
        "lines": line_counts,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def measure(df: DataFrame, id_column: str, text_column: str, *group: str) -> DataFrame:
    """(id, group columns g0.., statistics, n_lines, base_failed) of every row."""
    stats = text_statistics(F.col(f"`{text_column}`"))
    rows = df.select(
        F.col(f"`{id_column}`").alias("id"),
        *[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)],
        *[column.alias(name) for name, column in stats.items()],
    )
    rows = rows.select(
        "id",
        *[f"g{i}" for i in range(len(group))],
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.d").cast("long").alias("n_dup_lines"),
        F.col("words.r").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return rows.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    return [
        F.col("n_symbols") / F.col("n_words"),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / F.col("n_words"),
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)),
    ]


def _moments(rows: DataFrame, keys: list[str], core: Column, d: int) -> DataFrame:
    """Mean m_i and covariance v_ij per group over the rows in ``core``, spreads floored."""
    x = [F.when(core, F.col(f"x{i}")) for i in range(d)]
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    return rows.groupBy(*keys).agg(
        *[F.avg(x[i]).alias(f"m{i}") for i in range(d)],
        *[
            (F.coalesce(F.covar_pop(x[i], x[j]), F.lit(0.0)) + floor(i, j)).alias(f"v{i}{j}")
            for i, j in combinations_with_replacement(range(d), 2)
        ],
    )


def _cholesky(moments: DataFrame, d: int) -> DataFrame:
    """``moments`` with l_ij, the lower factor of the covariance, and half its log determinant."""
    for j in range(d):
        done = lambda i, j=j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        moments = moments.withColumn(f"l{j}{j}", F.sqrt(F.col(f"v{j}{j}") - done(j)))
        for i in range(j + 1, d):
            moments = moments.withColumn(f"l{i}{j}", (F.col(f"v{j}{i}") - done(i)) / F.col(f"l{j}{j}"))
    return moments.withColumn("size", sum((F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0)))


def _keyed(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table with one row per group; NULL keys are keys like any other."""
    named = table.toDF(*[f"t_{c}" if c in keys else c for c in table.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return rows.join(named, same).drop(*[f"t_{k}" for k in keys])


def _distances(rows: DataFrame, estimate: DataFrame, keys: list[str], d: int, *carried: str) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance d2 from their group's estimate, or its estimates."""
    out = _keyed(rows, estimate, keys)
    for i in range(d):
        left = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - left) / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)), F.lit(0.0))
    return out.withColumn("d2", d2).select(*rows.columns, *carried, "d2")


def _starts(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Medians, and quartile ranges as spreads, with three sets of correlations (column start)."""
    quartiles = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(d)]
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i]))
    middle = rows.groupBy(*keys).agg(*quartiles)
    middle = written(
        middle.select(
            *keys, *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(d)], *[spread(i).alias(f"s{i}") for i in range(d)]
        )
    )
    z = [((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")) for i in range(d)]
    bare = _keyed(rows, middle, keys).select(*keys, *[c.alias(f"z{i}") for i, c in enumerate(z)])
    long = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)), F.lit(0.0))
    bare = bare.withColumn("long", F.greatest(long, F.lit(1e-12)))
    pairs = [(i, j) for i in range(d) for j in range(i)]
    sign = lambda i, j: F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("long"))
    squashed = lambda i, j: F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}"))

    def correlation(of, i: int, j: int) -> Column:
        return F.try_divide(of(i, j), F.sqrt(of(i, i) * of(j, j)))

    shape = bare.groupBy(*keys).agg(
        *[correlation(squashed, i, j).alias(f"r1{i}{j}") for i, j in pairs],
        *[correlation(sign, i, j).alias(f"r2{i}{j}") for i, j in pairs],
    )
    known = _keyed(middle, written(shape), keys)

    def start(k: int) -> DataFrame:
        def v(i: int, j: int) -> Column:
            if i == j:
                return F.col(f"s{i}") * F.col(f"s{i}")
            r = F.col(f"r{k}{j}{i}") if k else F.lit(0.0)
            # a column that never changes has no correlation
            r = F.coalesce(r, F.lit(0.0))
            return SHRUNK * r * F.col(f"s{i}") * F.col(f"s{j}")

        return known.select(
            *keys, F.lit(k).alias("start"), *[f"m{i}" for i in range(d)],
            *[v(i, j).alias(f"v{i}{j}") for i, j in combinations_with_replacement(range(d), 2)],
        )

    table = start(0).unionByName(start(1)).unionByName(start(2))
    # the determinant of a start is not that of a core
    return written(_cholesky(table, d).withColumns({"size": F.lit(float("inf")), "moving": F.lit(True)}))


def _concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str], d: int) -> DataFrame:
    """One step of every estimate that moves; ``moving`` says whether its determinant fell."""
    moving = estimate.filter("moving")
    each = [*keys, "start"]
    near = _distances(rows, moving, keys, d, "start")
    n = F.count("*")
    needed = (n + (d + 1)) / (2 * n)
    cuts = near.groupBy(*each).agg(
        F.percentile_approx("d2", list(CORE_SHARES), 1000).alias("cuts"),
        F.least(needed, F.lit(1.0)).alias("needed"),
    )
    place = sum(((F.col("needed") > share).cast("int") for share in CORE_SHARES), F.lit(0))
    cuts = written(cuts.select(*each, F.get("cuts", place).alias("cut")))
    taken = written(_cholesky(_moments(_keyed(near, cuts, each), each, F.col("d2") <= F.col("cut"), d), d))
    before = moving.select(*each, F.col("size").alias("before"))
    fell = F.col("before") - F.col("size") > FALL / 2
    better = _keyed(taken, before, each).withColumn("moving", fell).drop("before")
    rested = _keyed(estimate, better.filter(~F.col("moving")).select(*each), each).withColumn("moving", F.lit(False))
    return written(
        better.filter("moving")
        .unionByName(rested.select(*better.columns))
        .unionByName(estimate.filter(~F.col("moving")).select(*better.columns))
    )


def _scaled(rows: DataFrame, estimate: DataFrame, keys: list[str], d: int) -> DataFrame:
    """``estimate`` with the scale that makes the median distance that of a normal distribution."""
    middle = _distances(rows, estimate, keys, d).groupBy(*keys).agg(
        F.greatest(F.percentile_approx("d2", 0.5, 1000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")
    )
    return written(_keyed(estimate, written(middle), keys))


def minimum_covariance(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """(keys, m, l, scale): the estimate of every group of ``rows``, which has columns x0 to x(d-1).

    Concentration ends by itself: each round lowers some determinant by a least factor, and floors bound
    them from below. ``scale`` never shrinks the floors.
    """
    estimate = _starts(rows, keys, d)
    while estimate.filter("moving").limit(1).count():
        estimate = _concentrate(rows, estimate, keys, d)
    best = estimate.groupBy(*keys).agg(F.min_by("start", F.struct("size", "start")).alias("start"))
    best = written(_keyed(estimate, written(best), [*keys, "start"]).drop("start", "moving"))
    raw = _scaled(rows, best, keys, d)
    apart = _keyed(_distances(rows, raw, keys, d), raw.select(*keys, "scale"), keys)
    inside = F.col("d2") / F.col("scale") <= CHI2_EDGE
    return _scaled(rows, written(_cholesky(_moments(apart, keys, inside, d), d)), keys, d)


def judge(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    group: tuple[str, ...] = ("lang", "source"),
    far: float = CHI2_FAR,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    One row per row of ``df``, repeated rows included. A NULL text counts as empty and fails; a NULL
    language or source is a group of its own. Estimates come from the documents that pass the base
    rules; in a group of one or two documents, or of equal ones, all are kept. Ties at the edge of the
    core belong to it. An empty table gives an empty result; other columns are ignored.
    """
    keys = [f"g{i}" for i in range(len(group))]
    measured = written(measure(df, id_column, text_column, *group))
    vector = _vector()
    passed = measured.filter(~F.col("base_failed")).select(*keys, *[x.alias(f"x{i}") for i, x in enumerate(vector)])
    estimate = minimum_covariance(passed, keys, len(vector))
    rows = measured.filter(~F.col("base_failed")).select(
        "id", "base_failed", *STATS, *keys, *[x.alias(f"x{i}") for i, x in enumerate(vector)]
    )
    apart = _keyed(_distances(rows, estimate, keys, len(vector)), estimate.select(*keys, "scale"), keys)
    distance = F.col("d2") / F.col("scale")
    judged = apart.select("id", *STATS, "base_failed", (distance <= far).alias("kept"), distance.alias("distance"))
    failed = measured.filter("base_failed").select(
        "id", *STATS, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")
    )
    return judged.unionByName(failed).withColumnRenamed("id", id_column)

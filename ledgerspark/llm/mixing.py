"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of ``size`` words from a source that needs ``target`` of its ``source_size`` words is due
target / source_size copies: a whole part and a fraction. Fractions are rounded in pairs: a random
amount of words moves from one document to the other until one of the two fractions becomes 0 or 1,
with odds that keep the expected copies of either; the words of the pair stay the same. The document
that is left with a fraction meets the next one.

Pairs are formed inside blocks of bounded size. What each block leaves over meets the leftovers of
other blocks of its source in the next level of a tree, until one document per source has a fraction.
Its words go to the document of the source whose size fits them best, what is then open to another,
three times at most. So a source misses its target by a few words, and the expected copies of at most
four documents per source are touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerspark.llm.common import count_words, uniform, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
BLOCK = 128
EPSILON = 1e-9
LAST_ROUNDS = 3


def ranked(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``rank``: its place from 0 by code point, NULL last; no task sees all rows."""
    spread = values.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    spread = written(spread)
    place = Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())
    counts = spread.groupBy("part").count().orderBy("part").collect()  # one row per partition
    before, total = [], 0
    for row in counts:
        before += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    offset = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return spread.withColumn("rank", (F.row_number().over(place) - 1 + offset).cast("long")).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_units, weight, target): the words each source contributes.

    ``sizes`` has (source, source_size, n_units). Sources take the weights in turn, by code point with
    NULL last, and share the sum of all sizes. No target exceeds ``most`` times its source's size;
    what exceeds it is shared again among the others by weight until none is above.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = written(
        ranked(sizes, "source").withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
    )
    cap = F.col("source_size") * float(most)
    # a step per source that reaches its cap at most; each is one row of sums
    level, full = 0.0, -1
    while True:
        open_ = F.col("weight") * level <= cap
        sums = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(~open_, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.count(F.when(~open_, 1)).alias("full"),
        ).first()
        if sums["full"] == full or not sums["weights"]:
            break
        full, level = sums["full"], (sums["all"] - sums["capped"]) / sums["weights"]
    return table.withColumn("target", F.least(F.col("weight") * level, cap)).drop("rank")


def _pivot(state: Column, unit: Column) -> Column:
    """One step of the fold: the document with a fraction so far meets the next one."""
    held, done = state["held"], state["done"]
    p, w = held["p"], held["w"]
    q, v = unit["p"], unit["w"]
    up = F.least((1 - p) * w, q * v)  # words that can move to the held document
    down = F.least(p * w, (1 - q) * v)  # and away from it
    rises = unit["u"] * (up + down) < down
    new_p = F.when(rises, F.when((1 - p) * w <= q * v, 1.0).otherwise(p + up / w)).otherwise(
        F.when(p * w <= (1 - q) * v, 0.0).otherwise(p - down / w)
    )
    new_q = F.when(rises, F.when((1 - p) * w <= q * v, q - up / v).otherwise(0.0)).otherwise(
        F.when(p * w <= (1 - q) * v, q + down / v).otherwise(1.0)
    )
    whole = lambda x: F.when(x < EPSILON, 0.0).when(x > 1 - EPSILON, 1.0).otherwise(x)

    def settle(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        a_done, b_done = (a == 0) | (a == 1), (b == 0) | (b == 1)
        as_unit = lambda x, prob: F.struct(x["key"].alias("key"), prob.alias("p"), x["w"].alias("w"), x["u"].alias("u"))
        mine, other = as_unit(held, a), as_unit(unit, b)
        settled = F.concat(F.filter(F.array(mine), lambda _: a_done), F.filter(F.array(other), lambda _: b_done))
        rest = F.when(~a_done, mine).when(~b_done, other)
        return F.struct(rest.alias("held"), F.concat(done, settled).alias("done"))

    met = F.get(
        F.transform(F.array(F.struct(whole(new_p).alias("a"), whole(new_q).alias("b"))), settle), F.lit(0)
    )
    alone = F.struct(
        F.struct(unit["key"].alias("key"), q.alias("p"), v.alias("w"), unit["u"].alias("u")).alias("held"),
        done.alias("done"),
    )
    return F.when(held.isNull(), alone).otherwise(met)


UNIT = "struct<key:bigint,p:double,w:double,u:double>"


def _fold(units: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, block, held, done) of every block of units (source, block, key, p, w)."""
    unit = F.struct(
        F.col("w").alias("size"), "key", "p", "w", uniform(F.lit(seed), F.lit(level), F.col("key")).alias("u")
    )
    grouped = units.groupBy("source", "block").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    start = F.struct(
        F.lit(None).cast(UNIT).alias("held"), F.array().cast(f"array<{UNIT}>").alias("done")
    )
    state = F.aggregate("units", start, _pivot)
    return grouped.select("source", "block", state.alias("s")).select("source", "block", "s.held", "s.done")


def dependent_rounding(units: DataFrame, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Round fractions p of units (source, key, p, w) with their sources' words kept.

    Returns (source, key, w, up) of the settled units, up being 0 or 1, and (source, key, p, w) of the
    at most one unit per source that keeps a fraction. ``key`` is unique.
    """
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    blocks = written(
        units.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    )
    now = units.join(blocks, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "key", "p", "w", F.pmod(F.xxhash64(F.lit(seed), "key"), "blocks").alias("block")
    )
    settled, level = [], 0
    width = math.ceil(most / block)
    while True:
        folded = written(_fold(now, level, seed))
        settled.append(
            folded.select("source", F.explode("done").alias("d")).select(
                "source", "d.key", "d.w", F.col("d.p").cast("int").alias("up")
            )
        )
        left = folded.filter("held IS NOT NULL").select("source", "block", "held.key", "held.p", "held.w")
        if width <= 1:
            break
        level, width = level + 1, math.ceil(width / block)
        now = left.withColumn("block", F.floor(F.col("block") / block).cast("long"))
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    return done, left.drop("block")


def _placed(settled: DataFrame, left: DataFrame, rounds: int) -> DataFrame:
    """(key, up): units to round the other way, so that the words of the last fractions find a place.

    Each round turns the unit of every source that brings its open words nearest to 0, if any does.
    """
    signed = F.when(F.col("up") == 0, F.col("w")).otherwise(-F.col("w"))
    turns = written(
        settled.select("source", "key", signed.alias("gain")).unionByName(
            left.select("source", "key", F.col("w").alias("gain"))
        )
    )
    now = left.select(
        F.col("source").alias("s"),
        (F.col("p") * F.col("w")).alias("words"),
        F.array().cast("array<struct<key:bigint,gain:double>>").alias("turned"),
    )
    for _ in range(rounds):
        now = written(now)
        same = F.col("source").eqNullSafe(F.col("s"))
        fresh = ~F.exists("turned", lambda t: t["key"] == F.col("key"))
        best = turns.join(now, same).filter(fresh).groupBy(F.col("s").alias("s1")).agg(
            F.min(F.struct(F.abs(F.col("words") - F.col("gain")).alias("miss"), "key", "gain")).alias("best")
        )
        better = F.col("best.miss") < F.abs("words")
        one = F.array(F.struct(F.col("best.key").alias("key"), F.col("best.gain").alias("gain")))
        now = now.join(best, F.col("s").eqNullSafe(F.col("s1")), "left").select(
            "s",
            F.when(better, F.col("words") - F.col("best.gain")).otherwise(F.col("words")).alias("words"),
            F.when(better, F.concat("turned", one)).otherwise(F.col("turned")).alias("turned"),
        )
    return now.select(F.explode("turned").alias("t")).select(
        "t.key", F.when(F.col("t.gain") > 0, 1).otherwise(-1).alias("up")
    )


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 0,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row of ``df``.

    ``taken`` is copies times size. NULL texts have size 0 and a NULL source is a source of its own.
    Rows equal in id, source and size are rounded as one unit and share its copies as evenly as can
    be, so repeated rows are well defined; documents of size 0 take no part and get no copies. An
    empty table gives an empty result. Random numbers depend on the seed and the rows' keys only, so
    reruns agree. Other columns are ignored.
    """
    sized = df.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{source_column}`").alias("source"),
        count_words(F.col(f"`{text_column}`")).alias("size"),
    )
    units = written(
        sized.groupBy("id", "source", "size")
        .agg(F.count("*").alias("n"))
        .withColumn("key", F.xxhash64("id", "source", "size"))
    )
    sums = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_units")
    )
    targets = written(source_targets(sums, weights, most).drop("weight", "n_units"))
    t = targets.withColumnRenamed("source", "s")
    due = F.when(F.col("size") > 0, F.col("target") / F.col("source_size") * F.col("n")).otherwise(0.0)
    units = units.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("due", due)
    near = F.round("due").cast("long")
    exact = F.abs(F.col("due") - near) < EPSILON
    units = written(
        units.withColumn("whole", F.when(exact, near).otherwise(F.floor("due").cast("long"))).withColumn(
            "p", F.when(exact, 0.0).otherwise(F.col("due") - F.floor("due"))
        )
    )
    fractions = units.filter("p > 0").select("source", "key", "p", F.col("size").cast("double").alias("w"))
    settled, left = dependent_rounding(fractions, seed, block)
    left = written(left)
    settled = written(settled)
    turned = _placed(settled, left, LAST_ROUNDS)
    raised = settled.filter("up = 1").select("key", "up").unionByName(turned)
    raised = written(raised.groupBy("key").agg(F.sum("up").cast("int").alias("up")))
    rounded = units.join(raised, "key", "left").withColumn(
        "total", F.col("whole") + F.coalesce("up", F.lit(0))
    )
    rows = rounded.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    copies = F.floor(F.col("total") / F.col("n")) + (F.col("i") < F.col("total") % F.col("n")).cast("long")
    return rows.select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )

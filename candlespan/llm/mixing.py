"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often each of its documents is taken on average: the whole part is taken in any case,
the fraction is an inclusion probability. The cube method decides the fractions. It moves three probabilities at a time
along the null space of the two balancing equations (documents and words), until one of the three is 0 or 1, so both totals are
kept exactly until at most two probabilities are left: the landing, which takes the combination nearest to the words due.

The flight runs in blocks of a source's documents, dealt by a hash. The up to two documents a block leaves open meet in larger
blocks, level by level, until a source has one block; only there the landing is made. So no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespan.llm.common import kept_in_worker, spare_name, stored, subset

#: Relative weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 4096
EDGE = 1e-9
#: Units of more than so many times the mean size are settled first.
LARGE = 4


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n_docs, source_size, target) from sizes (source, size); one row per source.

    Targets share the total size by weight; one above `cap` times its source's size stops there and its excess is shared by
    weight among the others. With the sources in the order of the ratio at which they reach the cap, those that stop are a
    prefix, so running sums settle it. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", (cap * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    final = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(everything)
    per = per.withColumn("final", final)
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def settle_large(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances with those of unusually large units settled, largest first.

    Three neighbours could not absorb such a unit, so the direction spreads over all open units in proportion to their sizes. It
    keeps the words exactly; the number of documents gives way here, as no choice of ordinary documents could keep both.
    """
    p, s = chance.astype(float), size.astype(float)
    for k in np.argsort(-s, kind="stable"):
        while EDGE < p[k] < 1 - EDGE:
            others = (p > EDGE) & (p < 1 - EDGE) & (s > 0)
            others[k] = False
            n, total, square = others.sum(), s[others].sum(), (s[others] ** 2).sum()
            if not n or s[k] <= LARGE * total / n:
                return p
            u = np.where(others, -s[k] * s / square, 0.0)
            u[k] = 1.0
            moving = np.abs(u) > 1e-12
            v, q = u[moving], p[moving]
            up = np.where(v > 0, 1 - q, q) / np.abs(v)
            down = np.where(v > 0, q, 1 - q) / np.abs(v)
            forward = rng.random() * (up.min() + down.min()) < down.min()
            p = p + (up.min() * u if forward else -down.min() * u)
            p[p <= EDGE], p[p >= 1 - EDGE] = 0.0, 1.0
    return p


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved to 0 or 1, but for two at most; sum(chance) and sum(chance * size) stay."""
    p, s = settle_large(chance, size, rng).tolist(), size.astype(float).tolist()
    draws = rng.random(len(p)).tolist()
    active: list[int] = []
    for k in range(len(p)):
        if EDGE < p[k] < 1 - EDGE:
            active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        top = max(map(abs, u))
        up = down = float("inf")
        for i, d in zip(active, u):
            d /= top
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        move = up if draws[k] * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += move * d / top
        active = [i for i in active if EDGE < p[i] < 1 - EDGE]
    return np.array([round(x) if x <= EDGE or x >= 1 - EDGE else x for x in p])


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last open chances set to the combination whose size is nearest to the size due, of equal ones the smaller."""
    out = chance.copy()
    open_ = np.flatnonzero((chance > EDGE) & (chance < 1 - EDGE))
    due = float((chance[open_] * size[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[k] for i, k in enumerate(open_) if m >> i & 1) - due), m))
    for i, k in enumerate(open_):
        out[k] = best >> i & 1
    return out


def _fly(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept_in_worker("mixing")
        group = group.sort_values(["spot", "key", "size"], kind="stable")
        seed = int(group["spot"].astype("int64").to_numpy().view("uint64").sum() & np.uint64(0x7FFFFFFF))
        chance = flight(group["chance"].to_numpy(), group["size"].to_numpy(), np.random.default_rng(seed))
        if last:
            chance = landing(chance, group["size"].to_numpy(float))
        group["chance"] = chance
        return group

    return run


def copies(rows: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """(key, size, source_size, target, copies) for each of rows (key, source, size): how often the mix takes the row.

    Same rows, same answer: the order of a block and its random numbers come from hashes of the keys.
    """
    plan = source_targets(rows, weights, cap).withColumn("rate", F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0)))
    plan = stored(plan.withColumn("blocks", F.ceil(F.col("n_docs") / block)), "mix-plan")
    rate = F.least(F.col("rate"), F.lit(float(cap)))
    units = rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).select(
        "key", "source", F.col("size").cast("long").alias("size"), "source_size", "target", F.floor(rate).cast("long").alias("base"),
        (rate - F.floor(rate)).alias("chance"), F.xxhash64("key").alias("spot"), "blocks",
    )
    units = units.withColumn("block", F.pmod(F.xxhash64("spot"), F.col("blocks")))
    blocks = plan.agg(F.max("blocks")).first()[0] or 0
    done = None
    settled = (F.col("chance") <= EDGE) | (F.col("chance") >= 1 - EDGE)
    while blocks:
        flown = stored(units.groupBy("source", "block").applyInPandas(_fly(blocks == 1), units.schema), "mix-flight")
        part = flown if blocks == 1 else flown.filter(settled)
        done = part if done is None else done.unionByName(part)
        if blocks == 1:
            break
        # a source that already has one block keeps it; the landing is made for all at the last level
        units = flown.filter(~settled).withColumn("block", F.floor(F.col("block") / (block // 2)))
        blocks = -(-blocks // (block // 2))
    done = units if done is None else done
    taken = F.col("base") + F.round("chance").cast("long")
    return done.select("key", "size", "source_size", "target", taken.alias("copies"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    Null text has size 0, and a source of size 0 takes nothing; null sources are one source. Repeated rows are decided on their
    own. An empty table gives no rows.
    """
    rows = subset(docs, "doc_id", "text", "source").select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"))
    return copies(rows).select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them; the columns stay as they are."""
    names = docs.columns
    key, total, number, nth, copy = (spare_name(n, docs) for n in ("mix_key", "mix_total", "mix_rows", "mix_nth", "mix_copy"))
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{n}`") for n in names]))
    rows = keyed.select(F.col(key).alias("key"), "source", word_count(F.col("text")).alias("size"))
    totals = copies(rows).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(number))
    # rows that are equal in all columns share their copies out among themselves
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    share = F.floor(F.col(total) / F.col(number)) + (F.col(nth) <= F.col(total) % F.col(number)).cast("long")
    out = keyed.join(totals, key).withColumn(nth, place).withColumn(copy, share.cast("int")).filter(F.col(copy) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*[F.col(f"`{n}`") for n in names])

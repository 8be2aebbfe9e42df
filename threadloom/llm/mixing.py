"""Mixing sources to target weights by cube-method balanced sampling.

Each source must give a share of the total size. Its documents are taken floor(r) times each, and once more with
probability r - floor(r), where r is the source's wanted tokens over its tokens. The extra copies are drawn by the cube
method: the vector of inclusion probabilities moves through the null space of the balancing equations (documents and
tokens), three fractional documents at a time, until a coordinate reaches 0 or 1. Blocks of a source move apart from
each other; what stays fractional (at most two documents a block) is gathered into new blocks, and the last two of a
source are the landing problem, settled by the nearer total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm import tokens
from threadloom.tables import cut

BLOCK = 4_096


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities through the null space of (1, size) until at most two are fractional. Sums are kept."""
    p = p.astype(float).copy()
    held: list[int] = []
    waiting = iter(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)).tolist())
    draws = iter(rng.random(2 * len(p) + 8))
    while True:
        while len(held) < 3 and (k := next(waiting, None)) is not None:
            held.append(k)
        if len(held) < 3:
            return p
        a, b, c = held
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        now = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)).min()
            down = np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)).min()
        p[held] = now + (up if next(draws) * (up + down) < down else -down) * u
        p[held] = np.where(p[held] < 1e-9, 0, np.where(p[held] > 1 - 1e-9, 1, p[held]))
        held = [k for k in held if 0 < p[k] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last fractional documents to the choice whose tokens, then documents, are nearest the wanted sums."""
    loose = np.flatnonzero((p > 0) & (p < 1))
    choices = [[(m >> k) & 1 for k in range(len(loose))] for m in range(1 << len(loose))]
    if not len(loose):
        return p
    want = (p[loose] * size[loose]).sum(), p[loose].sum()
    best = min(choices, key=lambda s: (abs((s * size[loose]).sum() - want[0]), abs(sum(s) - want[1])))
    out = p.copy()
    out[loose] = best
    return out


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, share, max_repeat, docs, tokens, wanted, rate): what each listed source is to give.

    share: the weight over the weights of the sources that have tokens. total: the wanted size of the mixture in
    tokens; by default the largest at which every such source can give its share. A source that can't give its part
    of a larger total gives max_repeat copies of all it has.
    """
    goals = targets.where("source is not null and weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    both = goals.join(have, "source", "left").na.fill(0, ["docs", "tokens"])
    able = F.when((F.col("tokens") > 0) & (F.col("max_repeat") > 0), F.col("weight"))
    every = W.partitionBy(F.lit(1))  # the rows are the listed sources
    both = both.withColumn("share", F.coalesce(able / F.sum(able).over(every), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("max_repeat") * F.col("tokens") / F.col("share"))).over(every)
    both = both.withColumn("wanted", F.col("share") * (F.lit(float(total)) if total else most))
    rate = F.when(F.col("share") > 0, F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeat").cast("double"))).otherwise(0.0)
    return both.withColumn("rate", rate)


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = tokens.TOKENIZER, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies >= 1) and its report.

    The report has one row for each source of targets: source, target_share, docs, tokens, copies, mixed_tokens,
    share, most_copies, max_repeat. Null and empty texts have no tokens and are never part of a mixture; nor are
    documents without a source or of a source that is not listed. Ties and repeated texts are separate documents; doc_id must be
    unique. Same input and seed give the same mixture. Empty tables give an empty mixture.
    """
    sizes = cut(tokens.count(docs.select("doc_id", "source", "text").where("source is not null"), tokenizer=tokenizer).select("doc_id", "source", "tokens").where("tokens > 0"))
    goals = cut(plan(sizes, targets, total))
    spark = docs.sparkSession
    rates = sizes.join(F.broadcast(goals.where("rate > 0").select("source", "rate", "max_repeat")), "source")
    whole = F.floor(F.col("rate") + 1e-9)
    units = rates.select("doc_id", "source", "tokens", whole.cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"))
    units = units.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    settled = units.where("p = 0 or p = 1")
    loose = units.where("p > 0 and p < 1")

    def move(last: bool):  # noqa: ANN202
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
            # a mixed order, so that units of all sizes meet
            rng = np.random.default_rng([seed, int(pdf["block"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
            pdf = pdf.iloc[rng.permutation(len(pdf))]
            p = flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(float), rng)
            return pdf.assign(p=land(p, pdf["tokens"].to_numpy(float)) if last else p)

        return step

    schema = "doc_id bigint, source string, tokens bigint, base int, p double, block bigint"
    done = [settled]
    left = {r["source"]: r["n"] for r in loose.groupBy("source").agg(F.count("*").alias("n")).collect()}  # the listed sources
    while left:
        last = max(left.values()) <= block
        blocks = F.create_map(*[F.lit(x) for s, n in left.items() for x in (s, max(1, -(-n // block)))])
        loose = loose.select("doc_id", "source", "tokens", "base", "p").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.element_at(blocks, F.col("source"))))
        # blocks are small but take time, so the number of tasks is that of the blocks and not left to their sizes
        tasks = min(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), sum(max(1, -(-n // block)) for n in left.values()))
        moved = cut(loose.repartition(tasks, "source", "block").groupBy("source", "block").applyInPandas(move(last), schema))
        done.append(moved.where("p = 0 or p = 1").drop("block"))
        if last:
            break
        loose = moved.where("p > 0 and p < 1")
        left = {r["source"]: r["n"] for r in loose.groupBy("source").agg(F.count("*").alias("n")).collect()}
    mixed = done[0]
    for d in done[1:]:
        mixed = mixed.unionByName(d)
    mixed = mixed.select("doc_id", "source", "tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")
    sums = mixed.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = goals.join(sums, "source", "left").na.fill(0, ["copies", "mixed_tokens", "most_copies"])
    all_ = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    report = report.select("source", F.col("share").alias("target_share"), "docs", "tokens", "copies", "mixed_tokens", F.coalesce(F.try_divide("mixed_tokens", all_), F.lit(0.0)).alias("share"), "most_copies", "max_repeat")
    return mixed, report

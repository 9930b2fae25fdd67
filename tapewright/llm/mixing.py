"""Drawing texts so that each source makes up its share of all tokens.

Each text of a source is wanted the same number of times, say 1.4: once for certain and once more with probability 0.4. The
fractions are rounded by the pivotal method: two texts trade tokens of probability, at random, until one of them is 0 or 1, and the
other meets the next. That keeps every text's expectation, and the drawn tokens of the source exactly, but for the one text that
is left over. Texts are rounded in buckets of bounded size, from the largest text to the smallest, and the leftovers of the buckets
meet in a reduction tree.

A text so large that its rounding alone would be seen in its source's share comes first: it is paired with all the rest of the source as
one, whose common probability takes the tokens it gains or loses. A source has a bounded number of those.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

BUCKET = 4096
FAN_IN = 256
#: The list of sources is held by the driver and broadcast.
MAX_SOURCES = 100_000
#: A text is large if it is over this part of the tokens wanted of its source (and of a tenth of those it holds: so 4000 at most are).
LARGE = 1 / 400
_EPS = 1e-12


def plain_source(c: Column) -> Column:
    """A source without differences of case, spaces and underscores."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s_\-]+", "_")


def pivot_pairs(items: Iterable[tuple[object, float, int]], rng: random.Random) -> tuple[dict[object, int], tuple[object, float, int] | None]:
    """Rounds (id, probability, size), pair by pair in their order: 0 or 1 for all but at most one, which is returned with
    the probability left to it. Every item keeps its expectation, and the sum of probability * size is kept exactly."""
    done: dict[object, int] = {}
    held: tuple[object, float, int] | None = None
    for item in items:
        if held is None:
            pair = [item]
        else:
            (x, p, s), (y, q, t) = held, item
            up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
            if rng.random() * (up + down) < down:
                p, q = p + up / s, q - up / t
            else:
                p, q = p - down / s, q + down / t
            pair = [(x, p, s), (y, q, t)]
        held = None
        for x, p, s in pair:
            if p <= _EPS or p >= 1 - _EPS:
                done[x] = int(p >= 0.5)
            else:
                held = (x, p, s)
    return done, held


def settle_large(large: Iterable[tuple[object, int]], times: float, most: int, tokens: int, rng: random.Random) -> tuple[dict[object, int], float]:
    """Copies of each (id, size) of a source of ``tokens`` in all, each text wanted ``times`` and at most ``most`` times; also how
    often the rest is then wanted.

    One after the other is paired with all that aren't settled: what it gains or loses by rounding, they lose or gain, so the sum of
    copies * size is kept. Where a text needs more than the others can give or take it is drawn by its own probability alone.
    """
    done: dict[object, int] = {}
    rest = float(tokens)
    for x, s in large:
        rest -= s
        base = int(times + _EPS)
        p = max(times - base, 0.0)
        up, down = (1 - p) * s, p * s
        more = rng.random() < p
        done[x] = base + more
        if up <= times * rest and down <= (most - times) * rest:
            times = min(max(times - (up if more else -down) / rest, 0.0), float(most)) if rest > 0 else times
    return done, times


def wanted_tokens(sources: dict[str, tuple[float, float]], total: float) -> dict[str, float]:
    """Tokens to draw of each source. ``sources``: name -> (share, most tokens it can give).

    A source that can't fill its share gives all it can; what it lacks is spread over the others in proportion to their
    shares, which may exhaust further ones. The sum is ``total`` unless all sources are exhausted. The level (tokens a share)
    at which a source is exhausted orders the sources, so one pass over them finds the level of the others.
    """
    order = sorted(sources, key=lambda s: (sources[s][1] / sources[s][0], s))
    left, shares, level = total, sum(s for s, _ in sources.values()), 0.0
    out: dict[str, float] = {}
    for k, name in enumerate(order):
        share, most = sources[name]
        level = max(left, 0.0) / shares
        if most > level * share:
            out |= {n: level * sources[n][0] for n in order[k:]}
            break
        out[name] = most
        left -= most
        shares = sum(sources[n][0] for n in order[k + 1 :])
    return out


def _settled(seed: int):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        times, most, held = float(pdf["times"][0]), int(pdf["most"][0]), int(pdf["held"][0])
        done, rest = settle_large(zip(range(len(pdf)), pdf["tokens"]), times, most, held, random.Random(f"{seed}/large/{keys[0]}"))
        return pd.DataFrame({"row": pdf["row"], "source": pdf["source"], "tokens": pdf["tokens"], "copies": pd.Series(done, dtype="int32"), "rest": rest})

    return run


def _rounded(seed: int, level: int, last: bool):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(f"{seed}/{level}/{keys[0]}/{keys[1]}")
        pdf = pdf.sort_values(["tokens", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        done, held = pivot_pairs(zip(range(len(pdf)), pdf["p"], pdf["tokens"]), rng)
        if held is not None and last:
            done[held[0]] = int(rng.random() < held[1])
            held = None
        pdf["extra"] = pd.array([done.get(i) for i in range(len(pdf))], dtype="Int32")
        if held is not None:
            pdf.loc[held[0], "p"] = held[1]
        return pdf

    return run


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(draw, shares). ``sized``: key, source, tokens; ``targets``: source, target_share, max_repeats.

    The draw has ``total_tokens``, by default as many as the listed sources hold. A source that can't fill its share of
    them stands at max_repeats copies of each of its texts, and what it lacks is spread over the others in proportion to their targets; a
    listed source without texts is one that lacks everything. If all sources are exhausted the draw is smaller than asked for. For
    shares that are met by all sources with texts, ask for a total that the scarcest can fill.

    Texts of sources not listed, with a NULL source or key, or of no tokens aren't drawn. Targets with a NULL or non-positive
    share or repeats below 1 get nothing; of repeated targets the largest share counts. Rows that repeat a key are texts of their own.
    ``draw`` has the key, source, tokens, copies (at least 1); ``shares`` one row per listed source: target_share, actual_share,
    tokens_available, tokens_drawn, n_texts, n_copies, max_repeats, shortfall_tokens (what it lacks to its target share of the
    drawn tokens, 0 if nothing) and capped (whether all its texts are used max_repeats times). No tokens at all: an empty draw
    and shares of 0.
    """
    spark = sized.sparkSession
    listed = (
        targets.where("source IS NOT NULL")
        .groupBy(plain_source(F.col("source")).alias("source"))
        .agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
        .select("source", F.coalesce("t.target_share", F.lit(0.0)).cast("double").alias("share"), F.coalesce("t.max_repeats", F.lit(0)).cast("int").alias("repeats"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    texts = sized.where(f"tokens > 0 AND source IS NOT NULL AND `{key}` IS NOT NULL").select(F.col(key).alias("row"), plain_source(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    # at most MAX_SOURCES short rows
    names = F.broadcast(spark.createDataFrame([(r["source"],) for r in listed], "source string"))
    texts = cut_lineage(texts.join(names, "source", "left_semi").select("row", "source", "tokens"))
    # one row per listed source at most
    have = {r["source"]: (r["t"], r["n"]) for r in texts.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    live = {r["source"]: (r["share"], r["repeats"]) for r in listed if r["share"] > 0 and r["repeats"] >= 1}
    most = {s: repeats * have.get(s, (0, 0))[0] for s, (_, repeats) in live.items()}
    total = sum(have[s][0] for s in live if s in have) if total_tokens is None else total_tokens
    wanted = wanted_tokens({s: (share, most[s]) for s, (share, _) in live.items()}, total)
    plan = []
    for s, (_, repeats) in live.items():
        if s in have and wanted[s] > 0:
            tokens, n = have[s]
            times = float(repeats) if wanted[s] >= most[s] else min(wanted[s] / tokens, float(repeats))
            plan.append((s, times, repeats, max(1, -(-n // BUCKET)), tokens, max(wanted[s], tokens / 10) * LARGE))
    # one row per listed source
    plans = F.broadcast(spark.createDataFrame(plan, "s string, times double, most int, buckets bigint, held bigint, large double"))
    t = texts.join(plans, F.col("source") == F.col("s")).drop("s")
    kind = t.schema["row"].dataType.simpleString()
    is_large = (F.col("tokens") > F.col("large")) & (F.col("times") < F.col("most"))
    large = t.where(is_large).groupBy("source").applyInPandas(_settled(seed), f"row {kind}, source string, tokens bigint, copies int, rest double")
    large = cut_lineage(large)
    # one row per listed source at most
    rest = F.broadcast(spark.createDataFrame(large.select("source", "rest").distinct().collect(), "s string, rest double"))
    t = t.where(~is_large).join(rest, F.col("source") == F.col("s"), "left").withColumn("times", F.coalesce("rest", "times"))
    t = t.withColumn("base", F.floor(F.col("times") + _EPS).cast("int")).withColumn("p", F.greatest(F.col("times") - F.col("base"), F.lit(0.0)))
    certain = t.where(F.col("p") <= _EPS).select("row", "source", "tokens", F.col("base").alias("copies"))
    todo = t.where(F.col("p") > _EPS).select("row", "source", "tokens", "base", "p", F.pmod(F.xxhash64("row"), "buckets").alias("bucket"))
    open_schema = f"row {kind}, source string, tokens bigint, base int, p double, bucket bigint, extra int"
    parts = [certain, large.drop("rest")]
    width, level = max((b for _, _, _, b, _, _ in plan), default=1), 0
    while True:
        last = width == 1
        step = todo.groupBy("source", "bucket").applyInPandas(_rounded(seed, level, last), open_schema)
        if not last:
            step = cut_lineage(step)
        parts.append(step.where("extra IS NOT NULL").select("row", "source", "tokens", (F.col("base") + F.col("extra")).alias("copies")))
        if last:
            break
        todo = step.where("extra IS NULL").drop("extra").withColumn("bucket", F.call_function("div", F.col("bucket"), F.lit(FAN_IN)))
        width, level = -(-width // FAN_IN), level + 1
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    drawn = drawn.where("copies > 0")

    sums = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_copies"))
    base = spark.createDataFrame(
        [(r["source"], r["share"], r["repeats"], int(have.get(r["source"], (0, 0))[0]), r["source"] in wanted and wanted[r["source"]] >= most[r["source"]]) for r in listed],
        "source string, target_share double, max_repeats int, tokens_available bigint, capped boolean",
    )
    report = base.join(sums, "source", "left").fillna(0, ["tokens_drawn", "n_texts", "n_copies"])
    whole = sum(share for share, _ in live.values()) or 1.0
    # the report has one row per listed source
    report = report.withColumn("all_tokens", F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1))))
    shares = report.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("tokens_drawn"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"),
        "tokens_available",
        "tokens_drawn",
        "n_texts",
        F.col("n_copies").cast("bigint").alias("n_copies"),
        "max_repeats",
        F.greatest(F.round(F.col("target_share") / F.lit(whole) * F.col("all_tokens")).cast("bigint") - F.col("tokens_drawn"), F.lit(0).cast("bigint")).alias("shortfall_tokens"),
        "capped",
    )
    return drawn.withColumnRenamed("row", key), shares

"""Consensus from several annotators, and the wording to be believed where several engines transcribed the same utterance.

Confidence-aware truth discovery alternates between the truth of every item, which minimises the weighted distance to the claims, and
the weights of the annotators, which come from the chi-squared upper bound on each one's error variance. The bound takes
the number of claims into account, so an annotator with few claims isn't trusted for a lucky few. ``truth_discovery`` does so
over a table of claims by any number of annotators: two aggregations a round, and one row per annotator kept from round to round.

The readings of an utterance are aligned word by word into slots; in a slot each engine claims a word or none, so slots are items. What
truth discovery needs of a slot is only which engines agree in it. Few engines make few such patterns (Bell(5) = 52
for four engines), so for at most ``PATTERN_ENGINES`` of them the slots are counted by pattern in one distributed aggregation and the
alternation runs over those counts: it covers every slot of every utterance and its cost doesn't depend on their number. More engines go
through the table of claims.

A weight is 1/bound, or -ln(bound): a slot's truth uses the latter, because words are right or
wrong, and 1/bound would let one very reliable engine outvote all others together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

# Fillers that make no difference, and the English number words.
FILLERS = {"um", "uh", "erm", "hmm", "mm", "eh", "ah"}
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = [(10**18, "quintillion"), (10**15, "quadrillion"), (10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}

#: One-sided level of the chi-squared bound.
ALPHA = 0.05
ROUNDS = 50
#: Errors that every annotator is taken to have besides those seen.
PRIOR_ERRORS = 0.5
#: Up to so many engines the slots are counted by pattern: Bell(9) = 21147 patterns at most.
PATTERN_ENGINES = 8
#: Weights are broadcast up to so many annotators and joined by shuffle beyond.
BROADCAST_ANNOTATORS = 200_000


def number_words(n: int) -> list[str]:
    if n < 20:
        return [UNITS[n]]
    if n < 100:
        return [TENS[n // 10]] + ([UNITS[n % 10]] if n % 10 else [])
    for size, name in SCALES:
        if n >= size:
            return number_words(n // size) + [name] + (number_words(n % size) if n % size else [])
    return []


def _ordinal(words: list[str]) -> list[str]:
    last = words[-1]
    return words[:-1] + [ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")]


@lru_cache(maxsize=65536)
def _spelled(token: str) -> tuple[str, ...]:
    """A numeral as number words, digit by digit if it has over 21; anything else as it is."""
    m = regex.fullmatch(r"(\d+)(?:\.(\d+))?(st|nd|rd|th)?", token)
    if not m or (m.group(2) and m.group(3)):
        return (token,)
    words = number_words(int(m.group(1))) if len(m.group(1)) <= 21 else [UNITS[int(d)] for d in m.group(1)]
    if m.group(2):
        words = [*words, "point", *(UNITS[int(d)] for d in m.group(2))]
    return tuple(_ordinal(words) if m.group(3) else words)


_APOSTROPHE = regex.compile(r"[’‘ʼ`´＇]")
_THOUSANDS = regex.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_TOKEN = regex.compile(r"\d+(?:\.\d+)?(?:st|nd|rd|th)?(?![\p{L}\p{N}])|[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}\p{N}]+)*")


def spoken_words(text: str | None) -> list[str]:
    """The words of a reading, without what makes no difference: case, marks, the shape of the apostrophe, numerals
    against number words, "%" against "percent", fillers. NULL and blank give none."""
    if not text:
        return []
    low = _THOUSANDS.sub("", _APOSTROPHE.sub("'", text.lower())).replace("%", " percent ")
    out: list[str] = []
    for t in _TOKEN.findall(low):
        if t[0].isdigit():
            out.extend(_spelled(t))
        elif t not in FILLERS:
            out.append(t)
    return out


def _steps(cost_sub, n: int, m: int, alike) -> list[tuple[int, int]]:
    """Cheapest alignment of n slots with m words: pairs of indices, -1 for none. Substitution before a gap. Words alike at both
    ends are paired without a search."""
    tail = 0
    while tail < min(n, m) and alike(n - 1 - tail, m - 1 - tail):
        tail += 1
    head = 0
    while head < min(n, m) - tail and alike(head, head):
        head += 1
    p, q = n - tail - head, m - tail - head
    row = [float(j) for j in range(q + 1)]
    back = [[2] * (q + 1)]
    for i in range(1, p + 1):
        new, way = [float(i)], [1]
        for j in range(1, q + 1):
            best, w = row[j - 1] + cost_sub(head + i - 1, head + j - 1), 0
            if row[j] + 1 < best:
                best, w = row[j] + 1, 1
            if new[j - 1] + 1 < best:
                best, w = new[j - 1] + 1, 2
            new.append(best)
            way.append(w)
        row = new
        back.append(way)
    out = [(n - 1 - k, m - 1 - k) for k in range(tail)]
    i, j = p, q
    while i or j:
        w = 1 if j == 0 else 2 if i == 0 else back[i][j]
        i, j = i - (w != 2), j - (w != 1)
        out.append((head + i if w != 2 else -1, head + j if w != 1 else -1))
    out.extend((k, k) for k in range(head - 1, -1, -1))
    return out[::-1]


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edit distance of two sequences of words, a column of the table in the bits of one number."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    last, full = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, distance = full, 0, len(a)
    for w in b:
        same = where.get(w, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same | down
        h_up, h_down = down | ~(d | up), up & d
        distance += bool(h_up & last) - bool(h_down & last)
        h_up, h_down = (h_up << 1 | 1) & full, h_down << 1 & full
        up, down = (h_down | ~(x | h_up)) & full, h_up & x
    return distance


def align(readings: Sequence[list[str] | None]) -> list[list[str | None]]:
    """Slots of the readings: per slot one word for each reading, "" where it has none there, None where there is no reading.

    The reading nearest to all others is the first row; the others join in order of their distance to it.
    """
    present = [k for k, r in enumerate(readings) if r]
    if not present:
        return []
    first = readings[present[0]]
    if all(readings[k] == first for k in present):
        return [[w if k in present else None for k in range(len(readings))] for w in first]
    far = {(a, b): word_distance(readings[a], readings[b]) for a in present for b in present if a < b}
    dist = lambda a, b: 0 if a == b else far[min(a, b), max(a, b)]
    pivot = min(present, key=lambda a: (sum(dist(a, b) for b in present), a))
    slots: list[list[str | None]] = [[w if k == pivot else None for k in range(len(readings))] for w in readings[pivot]]
    done = [pivot]
    for k in sorted((k for k in present if k != pivot), key=lambda k: (dist(pivot, k), k)):
        words = readings[k]
        seen = [{s[d] for d in done} for s in slots]

        def cost(i: int, j: int) -> float:
            if words[j] in seen[i]:
                return 0.0
            # a gap against a gap-holding slot is cheaper than an unlike word
            return 1.0 if any(w and (w[0] == words[j][0] or w[-1] == words[j][-1]) for w in seen[i]) else 1.01

        merged: list[list[str | None]] = []
        for i, j in _steps(cost, len(slots), len(words), lambda i, j: words[j] in seen[i]):
            slot = slots[i] if i >= 0 else ["" if d in done else None for d in range(len(readings))]
            slot[k] = words[j] if j >= 0 else ""
            merged.append(slot)
        slots = merged
        done.append(k)
    return slots


def pattern(slot: Sequence[str | None]) -> str:
    """Which engines agree: a letter per engine, the same for the same claim, "-" for no reading."""
    if slot.count(slot[0]) == len(slot):
        return ("-" if slot[0] is None else "a") * len(slot)
    names: dict[str, str] = {}
    return "".join("-" if w is None else names.setdefault(w, chr(97 + len(names))) for w in slot)


def chi_squared_quantile(p: float, n: int) -> float:
    """Quantile of the chi-squared distribution with n degrees of freedom (Wilson and Hilferty)."""
    z = _normal_quantile(p)
    return n * max(1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n)), 1e-9) ** 3


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def weight_of(bound: float, weighting: str) -> float:
    """The weight of an annotator: 1/bound ("inverse") or -ln(bound) ("log"), in which a bound is at most 0.5."""
    return 1 / bound if weighting == "inverse" else max(-math.log(min(bound, 0.5)), 1e-6)


def discover(counts: dict[str, int], engines: int, weighting: str = "log") -> tuple[dict[str, str], list[dict]]:
    """The winning letter of each pattern, and claims, errors, bound and weight of each engine.

    Alternates weighted truths and chi-squared weights until the truths stand still. Ties go to the claim of the
    engine with the largest weight, then to the earlier engine.
    """
    weights = [1.0] * engines
    winners: dict[str, str] = {}
    report: list[dict] = []
    for _ in range(ROUNDS):
        chosen = {}
        for p in counts:
            votes: dict[str, tuple[float, float, int]] = {}
            for s, c in enumerate(p):
                if c != "-":
                    total, top, order = votes.get(c, (0.0, 0.0, -s))
                    votes[c] = (total + weights[s], max(top, weights[s]), order)
            chosen[p] = max(votes, key=lambda c: (round(votes[c][0], 12), votes[c][1], votes[c][2])) if votes else "-"
        report = []
        for s in range(engines):
            n = sum(k for p, k in counts.items() if p[s] != "-")
            wrong = sum(k for p, k in counts.items() if p[s] not in ("-", chosen[p]))
            bound = (wrong + PRIOR_ERRORS) / chi_squared_quantile(ALPHA, n) if n else 0.5
            bound = min(bound, 0.5) if weighting == "log" else bound
            report.append({"claims": n, "errors": wrong, "bound": bound, "weight": weight_of(bound, weighting)})
        if chosen == winners:
            break
        winners = chosen
        weights = [r["weight"] for r in report]
    return winners, report


def _bound(errors: Column, claims: Column) -> Column:
    """The chi-squared upper bound on the error variance (as ``chi_squared_quantile``)."""
    c = F.lit(2.0) / (9 * claims)
    root = F.greatest(1 - c + F.lit(_normal_quantile(ALPHA)) * F.sqrt(c), F.lit(1e-9))
    return (errors + PRIOR_ERRORS) / (claims * root * root * root)


def truth_discovery(claims: DataFrame, item: str = "item", annotator: str = "annotator", label: str = "label", weighting: str = "inverse", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, annotators, overall) of a table of claims: one row per item, annotator and label, any number of each.

    Truths minimise the distance to the claims (0 or 1) weighted by the annotators' weights, which are 1/bound, or -ln(bound) with
    ``weighting="log"``, of the chi-squared upper bound on the annotator's error variance; both alternate until the weights stand still or
    for ``rounds`` rounds. Ties go to the label with the most reliable single annotator, then to the least label.

    ``items``: item, label (the consensus), support (its share of the weights), agreement (share of pairs of annotators with equal labels, NULL
    for a single claim), n_claims. ``annotators``: annotator, n_claims, n_errors, error_bound, weight. ``overall``: n_items, n_claims and
    alpha, Krippendorff's agreement corrected for chance (NULL without two claims on an item or without two labels).
    Rows with a NULL item, annotator or label make no claim; an annotator's repeats on an item count once, of
    different labels the least. No claims: no items, no annotators, and an alpha of NULL. Other columns are ignored.
    """
    c = claims.select(F.col(item).alias("i"), F.col(annotator).alias("a"), F.col(label).alias("l")).where("i IS NOT NULL AND a IS NOT NULL AND l IS NOT NULL")
    c = cut_lineage(c.groupBy("i", "a").agg(F.min("l").alias("l")))
    weights = cut_lineage(c.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(1.0)))
    few = weights.count() <= BROADCAST_ANNOTATORS
    spread = (lambda w: F.broadcast(w)) if few else (lambda w: w)

    def truths(w: DataFrame) -> DataFrame:
        votes = c.join(spread(w.select("a", "weight")), "a").groupBy("i", "l").agg(F.sum("weight").alias("votes"), F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
        first = F.min(F.struct((-F.round("votes", 9)).alias("v"), (-F.col("top")).alias("t"), "l"))["l"]
        pairs = F.sum(F.col("n") * (F.col("n") - 1))
        return votes.groupBy("i").agg(first.alias("truth"), F.sum("votes").alias("all"), F.sum("n").alias("claims"), pairs.alias("pairs"), F.max("votes").alias("won"))

    for _ in range(rounds):
        judged = c.join(truths(weights).select("i", "truth"), "i").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l") != F.col("truth")).cast("bigint")).alias("errors"))
        bound = _bound(F.col("errors"), F.col("n"))
        bound = F.least(bound, F.lit(0.5)) if weighting == "log" else bound
        weight = F.greatest(-F.log(bound), F.lit(1e-6)) if weighting == "log" else 1 / bound
        new = cut_lineage(judged.withColumn("bound", bound).withColumn("weight", weight))
        same = new.join(spread(weights.select("a", F.col("weight").alias("old"))), "a").agg(F.max(F.abs(F.col("weight") - F.col("old")) / F.col("weight"))).first()[0]
        weights = new
        if same is None or same < 1e-9:
            break
    if "errors" not in weights.columns:
        weights = weights.withColumn("errors", F.lit(None).cast("bigint")).withColumn("bound", F.lit(None).cast("double"))
    found = truths(weights)
    agreement = F.when(F.col("claims") > 1, F.col("pairs") / (F.col("claims") * (F.col("claims") - 1)))
    items = found.select(F.col("i").alias(item), F.col("truth").alias(label), (F.col("won") / F.col("all")).alias("support"), agreement.alias("agreement"), F.col("claims").alias("n_claims"))
    annotators = weights.select(F.col("a").alias(annotator), F.col("n").alias("n_claims"), F.col("errors").alias("n_errors"), F.col("bound").alias("error_bound"), "weight")
    return items, annotators, _alpha(c)


def _alpha(claims: DataFrame) -> DataFrame:
    """n_items, n_claims and Krippendorff's alpha of nominal labels, over items with two claims or more."""
    per_label = claims.groupBy("i", "l").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_label.groupBy("i").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    seen = sizes.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_claims"),
        F.sum(F.when(F.col("m") > 1, (F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1))).alias("apart"),
        F.sum(F.when(F.col("m") > 1, F.col("m"))).cast("double").alias("paired"),
    )
    totals = per_label.join(sizes.where("m > 1").select("i"), "i", "left_semi").groupBy("l").agg(F.sum("n").cast("double").alias("t"))
    by_chance = totals.agg(F.sum(F.col("t") * F.col("t")).alias("same"))
    # two tables of one row each
    both = seen.unionByName(by_chance, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_items", "n_claims", "apart", "paired", "same")])
    expected = (F.col("paired") * F.col("paired") - F.col("same")) / (F.col("paired") - 1)
    return both.select("n_items", "n_claims", F.when(expected > 0, 1 - F.col("apart") / expected).alias("alpha"))


def _aligned(engines: Sequence[str], key: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(e).to_pylist() for e in engines]
            slots, patterns = [], []
            for row in zip(*texts):
                words = [spoken_words(t) for t in row]
                own = align([w if t is not None and t.strip() else None for w, t in zip(words, row)])
                slots.append(["\t".join("\v" if w is None else w for w in s) for s in own])
                patterns.append([pattern(s) for s in own])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(slots, pa.list_(pa.string())), pa.array(patterns, pa.list_(pa.string()))], schema=schema)

    return run


def _decided(engines: Sequence[str], winners: dict[str, str] | None, schema: pa.Schema):
    """``winners``: the winning letter of each pattern; without it the patterns are the truths themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for slots, patterns in zip(b.column("slots").to_pylist(), b.column("patterns").to_pylist()):
                claims = [s.split("\t") for s in slots]
                truth = patterns if winners is None else [c[p.index(winners[p])] if winners[p] != "-" else "" for c, p in zip(claims, patterns)]
                agree = [sum(x == t for x in c if x != "\v") for c, t in zip(claims, truth)]
                held = [sum(x != "\v" for x in c) for c in claims]
                text = [w for w in truth if w]
                joined = "".join(text)
                differs = []
                for k in range(len(engines)):
                    own = [c[k] for c in claims]
                    differs.append(None if not own or own[0] == "\v" else "".join(own) != joined)
                rows.append((" ".join(text), sum(agree) / sum(held) if sum(held) else None, differs))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.bool_()))], schema=schema
            )

    return run


def consensus(readings: DataFrame, engines: dict[str, str], key: str = "utterance_id") -> tuple[DataFrame, DataFrame]:
    """(items, annotators): the consensus of each utterance and the reliability of each engine.

    ``engines``: column -> name to report. ``items`` has the key, ``wording`` (normalised words, "" if no engine read
    anything), ``agreement`` (share of the engines' claims that are the consensus, NULL without readings) and ``differs``, an
    array in the order of ``engines``: whether the reading's words differ from the consensus, NULL for no reading.
    ``annotators`` has engine, n_claims, n_errors, error_bound (chi-squared upper bound) and weight.
    NULL and blank readings make no claim; rows with a NULL key are left out; repeats of a key give one row
    (rows of one key that differ: the one least in the order of its readings). An empty table gives no items and
    engines without claims. Spacing inside words makes no difference.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

    names = list(engines)
    cols = [f"e{i}" for i in range(len(names))]
    plain = readings.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(a) for c, a in zip(names, cols)])
    plain = plain.groupBy("key").agg(F.min(F.struct(*cols)).alias("r")).select("key", "r.*")
    kt = plain.schema["key"].dataType
    first = StructType([StructField("key", kt), StructField("slots", ArrayType(StringType())), StructField("patterns", ArrayType(StringType()))])
    slots = cut_lineage(plain.mapInArrow(_aligned(cols, "key", to_arrow_schema(first)), first))
    spark = readings.sparkSession
    annotator_schema = "engine string, n_claims bigint, n_errors bigint, error_bound double, weight double"
    if len(names) <= PATTERN_ENGINES:
        # at most Bell(PATTERN_ENGINES + 1) rows
        counted = {r["p"]: r["n"] for r in slots.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
        winners, report = discover(counted, len(names))
        decided = slots
        rows = [(engines[n], r["claims"], r["errors"], float(r["bound"]), float(r["weight"])) for n, r in zip(names, report)]
        annotators = spark.createDataFrame(rows, annotator_schema)
    else:
        winners = None
        decided, annotators = _by_claims(slots, [engines[n] for n in names])
    second = StructType([StructField("key", kt), StructField("wording", StringType()), StructField("agreement", DoubleType()), StructField("differs", ArrayType(BooleanType()))])
    items = decided.mapInArrow(_decided(names, winners, to_arrow_schema(second)), second).withColumnRenamed("key", key)
    return items, annotators


def _by_claims(slots: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The slots with the truth of each in place of its pattern, and the annotators, by discovery over the table of claims."""
    each = slots.select("key", F.posexplode("slots").alias("slot", "claims"))
    claims = each.select(F.struct("key", "slot").alias("item"), F.posexplode(F.split("claims", "\t")).alias("k", "label")).where("label <> '\v'")
    # labels are told apart from none by the mark before them
    items, found, _ = truth_discovery(claims.withColumn("label", F.concat(F.lit("="), "label")), annotator="k", weighting="log")
    truth = items.groupBy(F.col("item.key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("item.slot", F.expr("substring(label, 2)").alias("word")))).alias("t"))
    decided = slots.join(truth, "key", "left").select("key", "slots", F.coalesce(F.transform("t", lambda x: x["word"]), F.array().cast("array<string>")).alias("patterns"))
    named = slots.sparkSession.createDataFrame(list(enumerate(names)), "k int, engine string")
    annotators = F.broadcast(named).join(found, "k", "left").select(
        "engine", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("error_bound", F.lit(0.5)).alias("error_bound"), F.coalesce("weight", F.lit(weight_of(0.5, "log"))).alias("weight")
    )
    return decided, annotators

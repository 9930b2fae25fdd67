"""Operators on words in order: phrases, segments, removal plans, terms, scripts and answers.

``words`` is one row per word: a document key, ``idx`` without holes, ``word``, ``start_ms``, ``end_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions import normalise as N
from tapewright.functions.exact_time import int_div


def locate(words: DataFrame, key: str, phrase: Sequence[str]) -> DataFrame:
    """Every occurrence of a phrase, overlapping ones too: key and the index of its first word. No occurrence gives no row."""
    said = words.where(N.spoken(F.col("word")) != "").select(key, "idx", N.spoken(F.col("word")).alias("w"))
    w = Window.partitionBy(key).orderBy("idx")
    hit = F.lit(True)
    for k, p in enumerate(phrase):
        hit = hit & F.coalesce((F.lead("w", k).over(w) if k else F.col("w")) == p, F.lit(False))
    return said.withColumn("hit", hit).where("hit").select(key, "idx")


def segments(words: DataFrame, key: str, pause_ms: int = 600) -> DataFrame:
    """Stretches that end after a final mark or before a pause longer than a limit: key, first_idx, text, start_ms, end_ms."""
    w = Window.partitionBy(key).orderBy("idx")
    ends = F.col("word").rlike(r"[.?!]$") | F.coalesce(F.lead("start_ms").over(w) - F.col("end_ms") > pause_ms, F.lit(False))
    s = words.withColumn("ends", ends.cast("int")).withColumn("n", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    return s.groupBy(key, "n").agg(F.min("idx").alias("first_idx"), F.array_join(said, " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("n")


def removal_plan(words: DataFrame, removed: Column, key: str, retention: float) -> DataFrame:
    """Time to cut so that the removed words go: per run of removed words its own time, the gap behind it and a share (1 - retention) of the
    gap before it. Retention 0 is tight, 0.35 balanced, 0.7 loose. Returns key, first_idx, last_idx, start_ms, end_ms."""
    w = Window.partitionBy(key).orderBy("idx")
    m = words.withColumn("gone", F.coalesce(removed, F.lit(False))).withColumn("prev_end", F.lag("end_ms").over(w)).withColumn("next_start", F.lead("start_ms").over(w))
    r = m.where("gone").withColumn("run", F.col("idx") - F.row_number().over(w)).groupBy(key, "run").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min_by("prev_end", "idx").alias("prev_end"), F.max_by("next_start", "idx").alias("next_start")
    )
    lead = F.greatest(F.col("s") - F.col("prev_end"), F.lit(0))
    start = F.when(F.col("prev_end").isNull(), F.col("s")).otherwise(F.col("s") - F.floor(lead * (1 - retention)).cast("bigint"))
    return r.select(key, "first_idx", "last_idx", start.alias("start_ms"), F.greatest("e", F.coalesce("next_start", "e")).alias("end_ms"))


def requested_removals(words: DataFrame, requested: DataFrame, key: str, retention: float) -> tuple[DataFrame, DataFrame]:
    """(plan, unknown) for the removal of requested words (key, idx; repeats count once): the cuts of ``removal_plan``, overlapping and touching ones joined, as key, start_ms,
    end_ms; and the requests for words that aren't there."""
    from tapewright.operators.intervals import merge

    # by (key, idx), so that the union below isn't taken for partitioned by key: where both sides of a union are partitioned alike, Spark 4.1 relies on it but
    # still puts the partitions of each side together as it likes, and words miss their requests
    r = requested.where(F.col(key).isNotNull() & F.col("idx").isNotNull()).select(key, "idx").repartition(key, "idx").distinct()
    # words are many more than their texts' size lets Spark believe, and a join might broadcast them: a request comes right before its word in one order instead
    u = words.select(key, "idx", "start_ms", "end_ms", F.lit(1).alias("__word")).unionByName(r.withColumn("__word", F.lit(0)), allowMissingColumns=True)
    asked = F.lag(F.when(F.col("__word") == 0, F.col("idx"))).over(Window.partitionBy(key).orderBy("idx", "__word"))
    marked = u.withColumn("__asked", asked).where("__word = 1")
    plan = merge(removal_plan(marked, F.col("__asked") == F.col("idx"), key, retention).where("end_ms > start_ms"), [key], "start_ms", "end_ms")
    # places have no holes, so the first and the last say which are there
    there = words.groupBy(F.col(key).alias("__wk")).agg(F.min("idx").alias("__first"), F.max("idx").alias("__last"))
    unknown = r.join(there.hint("merge"), F.col(key) == F.col("__wk"), "left").where("__wk IS NULL OR idx < __first OR idx > __last")
    return plan, unknown.select(key, "idx")


def term_vectors(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of the terms that mean something: no stop words, more than two letters."""
    t = words.select(*key, N.bare(F.col("word")).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(N.STOP_WORDS))
    return t.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


def neighbour_cohesion(words: DataFrame, key: str, window: int) -> DataFrame:
    """Cosine of the term counts of each window of words and the next: key, block, cohesion (0 where either has no terms)."""
    v = term_vectors(words.withColumn("block", int_div(F.col("idx"), F.lit(window))), [key, "block"])
    norms = v.groupBy(key, "block").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    nxt = v.select(F.col(key).alias("k2"), (F.col("block") - 1).alias("b2"), F.col("term").alias("t2"), F.col("n").alias("n2"))
    dot = v.join(nxt, (F.col(key) == F.col("k2")) & (F.col("block") == F.col("b2")) & (F.col("term") == F.col("t2"))).groupBy(key, "block").agg(F.sum(F.col("n") * F.col("n2")).alias("dot"))
    after = norms.select(F.col(key).alias("k3"), (F.col("block") - 1).alias("b3"), F.col("norm").alias("norm2"))
    j = norms.join(after, (F.col(key) == F.col("k3")) & (F.col("block") == F.col("b3"))).join(dot, [key, "block"], "left")
    return j.select(key, "block", F.coalesce(F.col("dot") / (F.col("norm") * F.col("norm2")), F.lit(0.0)).alias("cohesion"))


def distinctive_terms(counts: DataFrame, group: str, top: int = 6) -> DataFrame:
    """Terms said at least twice in a group that are rare outside: score here / (elsewhere + here / 8), ties by the term itself."""
    total = counts.groupBy("term").agg(F.sum("n").alias("all_n"))
    s = counts.where("n >= 2").join(total, "term").withColumn("score", F.col("n") / (F.col("all_n") - F.col("n") + F.col("n") / 8))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "term")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "term", F.col("n").alias("here"), (F.col("all_n") - F.col("n")).alias("elsewhere"), "score", "rank")


def section_labels(terms: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """The two most distinctive terms of each of the groups in capitals, "SECTION" for one that has none."""
    two = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: F.upper(x["term"])), " ")
    labels = terms.where("rank <= 2").groupBy(F.col(group).alias("__g")).agg(two.alias("label"))
    g = groups.select(group).distinct()
    return g.join(labels, F.col(group) == F.col("__g"), "left").select(group, F.coalesce("label", F.lit("SECTION")).alias("label"))


def parse_script(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Markers in square brackets and the words up to the next: key, ord, marker, panel ('top', 'centre', 'bottom', 'all' or NULL), line."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"\[([^\]]*)\]([^\[]*)"), F.lit(0))
    e = texts.select(key, F.posexplode(parts).alias("ord", "part"))
    marker = F.trim(F.regexp_extract("part", r"\[([^\]]*)\]", 1))
    low = F.lower(marker)
    panel = F.when(low.contains("top"), "top").when(low.contains("cent") | low.contains("middle"), "centre").when(low.contains("bottom"), "bottom").when(low.contains("all"), "all")
    line = F.trim(F.replace(F.regexp_replace("part", r"^\[[^\]]*\]", ""), F.lit("*"), F.lit("")))
    return e.select(key, "ord", marker.alias("marker"), panel.alias("panel"), line.alias("line"))


def label_of(line: Column) -> Column:
    """A caption from a line: without leading ordinals, the first sentence, trimmed, in capitals."""
    plain = F.regexp_replace(line, r"^\s*(?:\d+[.):]|[A-Za-z][.)])\s*", "")
    return F.upper(F.trim(F.regexp_extract(plain, r"^([^.!?\n]*)", 1)))


def parse_spans(answers: DataFrame, key: str, text: str, n_words: str) -> DataFrame:
    """Lines "FIRST-LAST | reason" of a model's answer: first, last, reason and why a span is rejected (NULL if it isn't).

    Rejected are malformed lines, reversed spans, unknown words, spans of 40 % of the words or more, and spans that overlap a kept one
    before them (decided in order, over the spans of one answer).
    """
    lines = answers.select(key, n_words, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    m = r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*\|\s*(.*?)\s*$"
    p = lines.withColumn("first", F.regexp_extract("line", m, 1).try_cast("int")).withColumn("last", F.regexp_extract("line", m, 2).try_cast("int")).withColumn("reason", F.regexp_extract("line", m, 3))
    why = (
        F.when(F.col("first").isNull() | F.col("last").isNull(), "malformed")
        .when(F.col("last") < F.col("first"), "reversed")
        .when(F.col("last") >= F.col(n_words), "unknown word")
        .when((F.col("last") - F.col("first") + 1) * 5 >= F.col(n_words) * 2, "too long")
    )
    p = p.withColumn("why", why)
    # what is kept so far is an ordered fold over the spans of one answer
    fit = p.where("why IS NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "first", "last"))).alias("spans"))
    none = F.array().cast("array<struct<line_no:int,first:int,last:int>>")
    kept = F.aggregate("spans", none, lambda acc, s: F.when(F.exists(acc, lambda k: (k["first"] <= s["last"]) & (s["first"] <= k["last"])), acc).otherwise(F.concat(acc, F.array(s))))
    fit = fit.select(F.col(key).alias("k2"), F.transform(kept, lambda s: s["line_no"]).alias("kept"))
    j = p.join(fit, F.col(key) == F.col("k2"), "left")
    return j.select(key, "line_no", "first", "last", "reason", F.coalesce("why", F.when(~F.array_contains("kept", F.col("line_no")), "overlap")).alias("why"))


def verdict(answer: Column, reverse: bool = False) -> Column:
    """'first', 'second' or 'unclear': the stand-alone letter A or B on the first line."""
    line = F.upper(F.element_at(F.split(F.trim(answer), "\n"), 1))
    a, b = line.rlike(r"(^|[^A-Z0-9])A([^A-Z0-9]|$)"), line.rlike(r"(^|[^A-Z0-9])B([^A-Z0-9]|$)")
    one, two = ("second", "first") if reverse else ("first", "second")
    return F.when(a & ~b, one).when(b & ~a, two).otherwise("unclear")


def agreed(first: Column, second: Column) -> Column:
    """Two verdicts with the options swapped: disagreement is unclear."""
    return F.when(first == second, first).otherwise("unclear")


def veto_stands(gap_seconds: Column, similarity: Column) -> Column:
    return ~((gap_seconds <= 1.0) & (similarity >= 0.65))


def lenient_object(text: Column) -> Column:
    """The JSON object from the first "{" to the last "}", once more without trailing commas if it doesn't parse: as text, or NULL."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    pick = lambda c: F.when(c.isNotNull() & (c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(pick(body), pick(fixed))


def short_phrase(text: Column) -> Column:
    """The first clause, of at most 80 characters."""
    return F.substr(F.trim(F.regexp_extract(text, r"^([^.;\n]*)", 1)), F.lit(1), F.lit(80))


def context_windows(counts: DataFrame, key: str, n_words: str, size: int, overlap: int) -> DataFrame:
    """Windows of words for a model: key, window_no, first, last (inclusive)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.col(n_words) - overlap - 1, F.lit(0)), F.lit(step))
    w = counts.where(F.col(n_words) > 0).select(key, n_words, F.posexplode(starts).alias("window_no", "first"))
    return w.select(key, "window_no", "first", (F.least(F.col("first") + size, F.col(n_words)) - 1).alias("last"))


def _sentence_ends(words: DataFrame, key: str) -> DataFrame:
    """key, idx, and for each word the last word of its document (``top``), the first sentence end behind it and the last one before it."""
    ahead, back = Window.partitionBy(key).orderBy("idx"), Window.partitionBy(key).orderBy(F.col("idx").desc())
    before = (Window.unboundedPreceding, -1)
    m = words.where(F.col(key).isNotNull()).select(key, "idx", F.when(F.col("word").rlike(r"[.?!]$"), F.col("idx")).alias("stop"))
    # looked for from the end: a frame that goes on to the last row is read anew for every word
    m = m.withColumn("top", F.max("idx").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_end", F.last("stop", ignorenulls=True).over(back.rowsBetween(*before)))
    return m.withColumn("prev_end", F.last("stop", ignorenulls=True).over(ahead.rowsBetween(*before))).drop("stop")


def _context(first: str, last: str, budget: int) -> list[Column]:
    return [F.greatest(F.coalesce(F.col("prev_end") + 1, F.lit(0)), F.col(first) - budget).alias("from"), F.least(F.coalesce("next_end", "top"), F.col(last) + budget).alias("to")]


def sentence_context(words: DataFrame, key: str, spans: DataFrame, budget: int) -> DataFrame:
    """Around each span (key, first, last) the words back to the last sentence end and on to the next, within a budget on either side."""
    m = _sentence_ends(words, key)
    a = m.select(F.col(key).alias("ka"), F.col("idx").alias("ia"), "prev_end")
    b = m.select(F.col(key).alias("kb"), F.col("idx").alias("ib"), "next_end", "top")
    # words are many more than their texts' size lets Spark believe: never broadcast
    j = spans.join(a.hint("merge"), (F.col(key) == F.col("ka")) & (F.col("first") == F.col("ia"))).join(b.hint("merge"), (F.col(key) == F.col("kb")) & (F.col("last") == F.col("ib")))
    return j.select(key, "first", "last", *_context("first", "last", budget))


def sentence_context_of_each(words: DataFrame, key: str, size: int, budget: int) -> DataFrame:
    """``sentence_context`` of every ``size`` words in a row, without a join."""
    w = Window.partitionBy(key).orderBy("idx")
    m = _sentence_ends(words, key)
    m = m.withColumn("last", F.lead("idx", size - 1).over(w)).withColumn("next_end", F.lead("next_end", size - 1).over(w))
    return m.where("last IS NOT NULL").select(key, F.col("idx").alias("first"), "last", *_context("idx", "last", budget))

"""Raw transcript lines into clean, ordered speaker turns.

Each line is parsed by the grammar in ``transcript_grammar``; that step and the removal of abandoned speech work line
by line. The place of a line without a stamp comes from a two-level carry over blocks of line numbers. Then the lines are
shuffled once more, by blocks of time: a block works out its speakers and sums up its runs of lines by one speaker, and only the runs
at the edges of blocks, whose speaker or end the block can't know, are joined across them. So no task holds a whole
transcript; what follows one stamp stays in one block. Spellings of labels are reconciled over the distinct labels of a transcript.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import exact_time as X
from tapewright.llm.transcript_grammar import one_edit, parse_line, spoken_words
from tapewright.operators.blocked import carry_forward
from tapewright.session import cut_lineage

LINES_PER_BLOCK = 4096
SECONDS_PER_BLOCK = 7200
_PARSED = "transcript_id bigint, line_id bigint, line_no int, second bigint, nanos bigint, label string, words array<string>, plain string, equal array<struct<a:string,b:string>>"
_ARROW = pa.schema(
    [
        ("transcript_id", pa.int64()),
        ("line_id", pa.int64()),
        ("line_no", pa.int32()),
        ("second", pa.int64()),
        ("nanos", pa.int64()),
        ("label", pa.string()),
        ("words", pa.list_(pa.string())),
        ("plain", pa.string()),
        ("equal", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))),
    ]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [parse_line(t) for t in b.column("raw_line").to_pylist()]
        cols = [
            b.column("transcript_id"),
            b.column("line_id"),
            b.column("line_no"),
            pa.array([x.second for x in lines], pa.int64()),
            pa.array([x.nanos for x in lines], pa.int64()),
            pa.array([x.label for x in lines], pa.string()),
            pa.array([x.words for x in lines], pa.list_(pa.string())),
            pa.array([" ".join(x.plain) for x in lines], pa.string()),
            pa.array([[{"a": p, "b": q} for p, q in x.equal] for x in lines], _ARROW.field("equal").type),
        ]
        yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)


@F.pandas_udf(T.StringType())
def _spoken(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(spoken_words(t)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The parts of each line; repeats of a line_id give one row. Rows with a NULL id or transcript are left out."""
    return (
        lines.select(F.col("transcript_id").cast("bigint").alias("transcript_id"), F.col("line_id").cast("bigint").alias("line_id"), F.coalesce(F.col("line_no").cast("int"), F.lit(-1)).alias("line_no"), "raw_line")
        .where("transcript_id IS NOT NULL AND line_id IS NOT NULL")
        .dropDuplicates(["transcript_id", "line_id"])
        .mapInArrow(_parse, _PARSED)
    )


def without_abandoned(parsed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Takes the words of the corrections out of the lines on whose second they fall, first occurrence, whole words."""
    c = corrections.where("transcript_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("transcript_id").alias("c_transcript"),
        X.whole_seconds("abandoned_start_num", "abandoned_start_den").alias("c_second"),
        _spoken("text").alias("c_words"),
    )
    c = c.where("c_second IS NOT NULL AND c_words <> ''").groupBy("c_transcript", "c_second").agg(F.array_sort(F.collect_set("c_words")).alias("cuts"))
    j = parsed.join(c, (F.col("transcript_id") == F.col("c_transcript")) & (F.col("second") == F.col("c_second")), "left").drop("c_transcript", "c_second")
    start = F.struct(F.concat(F.lit(" "), "plain", F.lit(" ")).alias("plain"), F.col("words").alias("words"))

    def cut(state, words):
        # the first occurrence as whole words; the words before it are counted by their spaces
        needle = F.concat(F.lit(" "), words, F.lit(" "))
        at = F.call_function("instr", state["plain"], needle)
        head = F.call_function("substring", state["plain"], F.lit(1), at)
        tail = F.call_function("substring", state["plain"], at + F.length(needle) - 1)
        before = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1
        n = F.size(F.split(words, " "))
        kept = F.concat(F.slice(state["words"], F.lit(1), before), F.slice(state["words"], before + n + 1, F.greatest(F.size(state["words"]) - before - n, F.lit(0))))
        return F.when(at > 0, F.struct(F.concat(head, F.substr(tail, F.lit(2))).alias("plain"), kept.alias("words"))).otherwise(state)

    cleaned = F.when(F.col("cuts").isNotNull(), F.aggregate("cuts", start, cut)).otherwise(start)
    return j.withColumn("clean", cleaned).withColumn("plain", F.trim("clean.plain")).withColumn("words", F.col("clean.words")).drop("clean", "cuts")


def _groups_of(labels: list[tuple[str, int]], equal: list[tuple[str, str]]) -> dict[str, str]:
    """Label -> the label that stands for its speaker: the most frequent of those joined."""
    count = dict(labels)
    for a, b in equal:
        count.setdefault(a, 0)
        count.setdefault(b, 0)
    parent = {x: x for x in count}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: str, b: str) -> None:
        a, b = sorted((root(a), root(b)), key=lambda x: (-count[x], x))
        parent[b] = a

    names = sorted((x for x in count if len(x) >= 4 and not x[-1].isdigit()), key=lambda x: (-count[x], x))
    # candidates share a deletion variant; without this the comparison would be of all pairs
    variants: dict[str, list[str]] = {}
    for x in names:
        seen = set()
        for v in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
            for y in variants.get(v, ()):
                if y not in seen and one_edit(x, y):
                    seen.add(y)
                    join(x, y)
            variants.setdefault(v, []).append(x)
    for a, b in equal:
        join(a, b)
    return {x: root(x) for x in count}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("speaker", T.StringType())])))
def _reconciled(labels: pd.Series, equal: pd.Series) -> pd.Series:
    out = []
    for own, pairs in zip(labels, equal):
        groups = _groups_of([(x["label"], x["n"]) for x in own], [(p["a"], p["b"]) for p in pairs])
        out.append([{"label": a, "speaker": b} for a, b in groups.items()])
    return pd.Series(out)


def speakers(parsed: DataFrame) -> DataFrame:
    """transcript_id, label, speaker: one speaker for all spellings of a label and the labels equated with it."""
    said = parsed.where("label IS NOT NULL").groupBy("transcript_id", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.lit(None).cast("struct<a:string,b:string>"))
    told = parsed.where("size(equal) > 0").select("transcript_id", F.explode("equal").alias("pair")).distinct().select("transcript_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("bigint").alias("n"), "pair")
    both = said.unionByName(told).groupBy("transcript_id").agg(
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))).alias("labels"), F.collect_list("pair").alias("equal")
    )
    return both.select("transcript_id", F.inline(_reconciled("labels", "equal")))


_ORDER = ["second", "nanos", "leader", "line_no", "line_id"]


def _runs(parsed: DataFrame, text: bool) -> DataFrame:
    """Per block of time: its runs of speech lines by one speaker (run 1, 2, ...; run 0 is lines before the first speech). ``who`` is
    NULL in a run before the first label of a block, ``heard`` is the speaker last named at the end of the run."""
    named = speakers(parsed).withColumnRenamed("transcript_id", "s_transcript").withColumnRenamed("label", "s_label")
    p = parsed.select("transcript_id", "line_id", "line_no", "second", "nanos", "label", (F.size("equal") > 0).alias("roster"), (F.col("plain") != "").alias("speech"), *([F.array_join("words", " ").alias("said")] if text else []))
    p = p.join(named, (F.col("transcript_id") == F.col("s_transcript")) & (F.col("label") == F.col("s_label")), "left").drop("s_transcript", "s_label", "label")

    p = p.withColumn("filed", X.floor_div(F.col("line_no").cast("bigint"), F.lit(LINES_PER_BLOCK).cast("bigint")))
    p = p.withColumn("stamp", F.when(F.col("second").isNotNull(), F.struct("second", F.col("line_no").alias("leader"), "nanos")))
    p = carry_forward(p, ["transcript_id"], "filed", ["line_no", "line_id"], "stamp", "lead").where("NOT roster")
    # lines before the first stamp come first, in blocks of line numbers
    p = p.withColumn("second", F.coalesce("lead.second", F.lit(-1).cast("bigint"))).withColumn("leader", F.coalesce("lead.leader", F.lit(-1)))
    p = p.withColumn("hour", F.when(F.col("second") < 0, F.lit(-1).cast("bigint")).otherwise(X.floor_div(F.col("second"), F.lit(SECONDS_PER_BLOCK).cast("bigint"))))
    p = p.withColumn("part", F.when(F.col("second") < 0, F.col("filed")).otherwise(F.lit(0).cast("bigint")))
    block = ["transcript_id", "hour", "part"]
    p = p.repartition(*block)
    cut = F.max(F.col("lead.nanos").isNull().cast("int")).over(Window.partitionBy(*block, "second"))
    p = p.withColumn("nanos", F.when(cut == 1, F.lit(0)).otherwise(F.col("lead.nanos"))).drop("lead", "stamp", "filed", "roster")

    w = Window.partitionBy(*block).orderBy(*_ORDER)
    p = p.withColumn("who", F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last(F.when(F.col("speech"), F.struct("who")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("before", before).withColumn("fresh", (F.col("speech") & (F.col("before").isNull() | ~F.col("before.who").eqNullSafe(F.col("who")))).cast("int"))
    p = p.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*_ORDER)
    spoken = F.when(F.col("speech"), at)
    what = [F.min(spoken).alias("a"), F.max(spoken).alias("z"), F.count(spoken).alias("n_lines"), F.max(F.when(F.col("speech"), F.struct("who")))["who"].alias("who"), F.max_by("who", at).alias("heard")]
    if text:
        what.append(_in_order(F.when(F.col("speech"), F.struct(at.alias("at"), "said")), "said"))
    return p.groupBy(*block, "run").agg(*what).withColumn("final", F.col("run") == F.max("run").over(Window.partitionBy(*block)))


def _in_order(piece: Column, name: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x[name]), " ").alias("said")


def speaker_turns(lines: DataFrame, corrections: DataFrame, text: bool = True) -> DataFrame:
    """The turns of each transcript: one row per longest sequence of speech lines by one speaker, in order of time.

    Lines come in the order of their stamps; lines on one second keep the order in which they were filed
    unless all stamps of that second have fractions. A line without a stamp follows the line filed before it, a line without
    a label has the speaker of the line before it in time (NULL if there is none). A line without a word of
    speech is skipped, and so is one that only equates labels. A NULL or empty line has no speech; repeats of a
    line_id count once; an empty table gives no turn. Other columns are ignored.

    Returns transcript_id, first_line_id, last_line_id, speaker, start_seconds, n_lines and, unless ``text`` is false, turn_no (from 0) and text.
    """
    parsed = cut_lineage(without_abandoned(parse_lines(lines), corrections))
    runs = cut_lineage(_runs(parsed, text))
    # what a block alone can't decide: whose the lines before its first label are, and whether its first and last run go on
    inner = runs.where("run > 2 AND NOT final")
    w = Window.partitionBy("transcript_id").orderBy("hour", "part", "run")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = runs.where("run <= 2 OR final").withColumn("who", F.coalesce("who", F.last("heard", ignorenulls=True).over(earlier)))
    speech = F.col("n_lines") > 0
    edges = edges.withColumn("before", F.last(F.when(speech, F.struct("who")), ignorenulls=True).over(earlier))
    fresh = speech & ((F.col("run") > 2) | F.col("before").isNull() | ~F.col("before.who").eqNullSafe(F.col("who")))
    edges = edges.withColumn("turn", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    what = [F.min("a").alias("a"), F.max("z").alias("z"), F.first("who").alias("who"), F.sum("n_lines").alias("n_lines")]
    keep = ["transcript_id", "a", "z", "who", "n_lines"]
    if text:
        # a last run has the turns inside its block before it, and those follow on the block's second run
        inside = F.when(F.col("final") & (F.col("run") > 2), F.col("run") - 3).otherwise(0)
        edges = edges.withColumn("turn_no", F.col("turn") - 1 + F.sum(inside).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        second = edges.where("run = 2").select(F.col("transcript_id").alias("s_transcript"), F.col("hour").alias("s_hour"), F.col("part").alias("s_part"), F.col("turn_no").alias("second_no"))
        inner = inner.join(second, (F.col("transcript_id") == F.col("s_transcript")) & (F.col("hour") == F.col("s_hour")) & (F.col("part") == F.col("s_part"))).withColumn("turn_no", F.col("second_no") + F.col("run") - 2)
        what += [F.min("turn_no").alias("turn_no"), _in_order(F.struct("a", "said"), "said")]
        keep += ["turn_no", "said"]
    merged = edges.where(speech).groupBy("transcript_id", "turn").agg(*what)
    turns = inner.select(*keep).unionByName(merged.select(*keep))
    return turns.select(
        "transcript_id",
        F.col("a.line_id").alias("first_line_id"),
        F.col("z.line_id").alias("last_line_id"),
        F.col("who").alias("speaker"),
        F.when(F.col("a.second") >= 0, F.col("a.second") + F.coalesce(F.col("a.nanos"), F.lit(0)) / F.lit(10**9)).alias("start_seconds"),
        "n_lines",
        *([F.col("turn_no").cast("bigint").alias("turn_no"), F.col("said").alias("text")] if text else []),
    )

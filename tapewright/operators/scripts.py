"""Scripts against what was said: locating lines, reading back the output, captions, sections, and scoring of labelled frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators import sequences as Q


#: How alike a line must be, the longest pause inside a breath, how many words a line grows on either side, and the pauses
#: around a false start.
LEAST_ALIKE = 0.45
BREATH_MS = 350
BREATH_WORDS = 8
STUMBLE_MS, SHORT_PAUSE_MS = 300, 150


def _closes(word: str) -> bool:
    return word.rstrip()[-1:] in (".", "?", "!")


class _Heard:
    """The words of one recording in order."""

    def __init__(self, words: pd.DataFrame):
        w = words.sort_values("idx")
        self.idx, self.word, self.start, self.end = (w[c].tolist() for c in ("idx", "word", "start_ms", "end_ms"))
        self.key = [Q.word_key(x or "") for x in self.word]
        self.closes = [_closes(x or "") for x in self.word]

    def gap(self, i: int) -> float:
        """Silence before word i; endless at either end."""
        return self.start[i] - self.end[i - 1] if 0 < i < len(self.word) else float("inf")


def _placed(lines: list[list[str]], heard: _Heard, grow: bool) -> list[tuple[int, int, float] | tuple[None, None, float]]:
    """Where each line is: anchors first, then each takes in the unclaimed words of its breath, behind it before ahead of it."""
    anchors = [Q.locate_line(x, heard.key, heard.closes, LEAST_ALIKE) for x in lines]
    taken = {i for h in anchors if h and h[2] >= LEAST_ALIKE for i in range(h[0], h[1] + 1)}
    out: list = []
    for h in anchors:
        if h is None or h[2] < LEAST_ALIKE:
            out.append((None, None, h[2] if h else 0.0))
            continue
        a, z, s = h
        for _ in range(BREATH_WORDS if grow else 0):
            if z + 1 >= len(heard.word) or z + 1 in taken or heard.gap(z + 1) >= BREATH_MS or heard.closes[z]:
                break
            z += 1
            taken.add(z)
        for _ in range(BREATH_WORDS if grow else 0):
            if a == 0 or a - 1 in taken or heard.gap(a) >= BREATH_MS or heard.closes[a - 1]:
                break
            a -= 1
            taken.add(a)
        out.append((a, z, s))
    return out


def _cogrouped(left: DataFrame, words: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """A kernel per key over its rows and words: a script is located in one recording at a time."""
    kind = left.schema["key"].dataType.simpleString()
    w = words.select(F.col(key).alias("key"), "idx", "word", "start_ms", "end_ms")
    columns = ["key", *[x.split()[0] for x in schema.split(", ")]]

    def run(k: tuple, own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([(k[0], *r) for r in kernel(own.sort_values("ord").to_dict("records"), _Heard(said))] if len(own) else [], columns=columns)
        return out.astype({x.split()[0]: "Int64" for x in schema.split(", ") if x.split()[1] in ("int", "bigint")})

    return left.groupBy("key").cogroup(w.groupBy("key")).applyInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def locate_lines(lines: DataFrame, words: DataFrame, key: str, grow: bool = True) -> DataFrame:
    """Where each line of a script (key, ord, line) is in the words (key, idx, word, start_ms, end_ms): first_idx, last_idx, start_ms, end_ms (NULL where it isn't) and
    similarity, of a near miss too (0 where nothing is alike).

    Words match by ``same_word``. ``grow``: a stretch then takes in the unclaimed words beside it.
    """

    def kernel(own: list[dict], heard: _Heard) -> list[tuple]:
        spans = _placed([Q.key_words(r["line"]) for r in own], heard, grow)
        return [(r["ord"], r["line"], *((None,) * 4 if a is None else (heard.idx[a], heard.idx[z], heard.start[a], heard.end[z])), s) for r, (a, z, s) in zip(own, spans)]

    l = lines.select(F.col(key).alias("key"), "ord", "line")
    return _cogrouped(l, words, key, kernel, "ord int, line string, first_idx int, last_idx int, start_ms bigint, end_ms bigint, similarity double").where("ord IS NOT NULL")


def stumbles(located: DataFrame, words: DataFrame, key: str, pause_ms: int = STUMBLE_MS) -> DataFrame:
    """Words at the edge of a located line that the line doesn't have and silence sets apart: key, ord, idx, edge, start_ms, end_ms.

    At the end a pause must follow, and the word before be one of the line or a short pause lie between; at the front pauses must lie on both sides. Lines
    of a single word have none.
    """

    def kernel(own: list[dict], heard: _Heard) -> list[tuple]:
        at = {x: i for i, x in enumerate(heard.idx)}
        out = []
        for r in own:
            if r["first_idx"] is None or r["first_idx"] != r["first_idx"] or r["first_idx"] == r["last_idx"]:
                continue
            a, z, want = at[int(r["first_idx"])], at[int(r["last_idx"])], Q.key_words(r["line"])
            scripted = lambda i: any(Q.same_word(x, heard.key[i]) for x in want)
            if not scripted(z) and heard.gap(z + 1) >= pause_ms and (scripted(z - 1) or heard.gap(z) >= SHORT_PAUSE_MS):
                out.append((r["ord"], heard.idx[z], "last", heard.start[z], heard.end[z]))
            if not scripted(a) and heard.gap(a) >= pause_ms and heard.gap(a + 1) >= pause_ms:
                out.append((r["ord"], heard.idx[a], "first", heard.start[a], heard.end[a]))
        return out

    l = located.select(F.col(key).alias("key"), "ord", "line", "first_idx", "last_idx")
    return _cogrouped(l, words, key, kernel, "ord int, idx int, edge string, start_ms bigint, end_ms bigint")


def without_stumbles(located: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The located lines with the stumbles cut off at the edges."""
    f = found.groupBy(F.col(key).alias("s_key"), F.col("ord").alias("s_ord")).agg(F.max(F.when(F.col("edge") == "first", F.col("end_ms"))).alias("s_end"), F.min(F.when(F.col("edge") == "last", F.col("start_ms"))).alias("s_start"))
    j = located.join(f, (F.col(key) == F.col("s_key")) & (F.col("ord") == F.col("s_ord")), "left")
    start = F.when(F.col("s_end") < F.col("end_ms"), F.col("s_end")).otherwise(F.col("start_ms"))
    end = F.when(F.col("s_start") > F.col("start_ms"), F.col("s_start")).otherwise(F.col("end_ms"))
    return j.withColumn("start_ms", start).withColumn("end_ms", end).drop("s_key", "s_ord", "s_start", "s_end")


def script_problems(located: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """What must be settled before a script is cut: key, ord, problem ('not found', 'overlaps another line' or 'false start'), text, at_ms, similarity.

    For a line that isn't found the text is the stretch of as many words that is most like it; for one that overlaps, the other line's number."""

    def kernel(own: list[dict], heard: _Heard) -> list[tuple]:
        out = []
        for r in own:
            if r["first_idx"] is not None and r["first_idx"] == r["first_idx"]:
                continue
            want = Q.key_words(r["line"])
            masks = Q.match_masks(want, heard.key, Q.same_word)
            best = (0.0, -1)
            for i in range(len(heard.key)):
                part = heard.key[i : i + len(want)]
                s = Q.common_length(len(want), masks, part) / max(len(want), len(part)) if part else 0.0
                if s > best[0]:
                    best = (s, i)
            s, i = best
            out.append((r["ord"], "not found", None if i < 0 else " ".join(heard.word[i : i + len(want)]), None if i < 0 else heard.start[i], s))
        return out

    from tapewright.operators.intervals import overlap_pairs

    schema = "ord int, problem string, text string, at_ms bigint, similarity double"
    missing = _cogrouped(located.select(F.col(key).alias("key"), "ord", "line", "first_idx"), words, key, kernel, schema)
    l = located.where("start_ms IS NOT NULL").select(key, "ord", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    other = l.select(key, F.col("ord").alias("ord2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = overlap_pairs(l, other, [key], ("s", "e"), ("s2", "e2"), 10_000).where("ord < ord2")
    twice = pairs.select(key, "ord", F.lit("overlaps another line").alias("problem"), F.col("ord2").cast("string").alias("text"), F.greatest("s", "s2").alias("at_ms"), F.lit(None).cast("double").alias("similarity"))
    false = stumbles(located, words, key).select(key, "ord", F.lit("false start").alias("problem"), F.col("edge").alias("text"), F.col("start_ms").alias("at_ms"), F.lit(None).cast("double").alias("similarity"))
    return missing.unionByName(twice).unionByName(false)


def read_back(plan: DataFrame, output: DataFrame, source: DataFrame, key: str, slack_ms: int = 600) -> DataFrame:
    """Whether an output says what its plan says: key, ord, heard, similarity, chopped and repeated (the words, NULL if not).

    ``plan``: key, ord, line, source_start, source_end, start, end (of the output), all in ms; ``output`` and ``source`` are words. A line is heard if 0.45 of its words
    are, in order, around its place. It is chopped if none of the last two words said in its source is in the last second of its place. It is repeated
    at the join if all of those that have four letters or more come again among the first five words behind the join."""
    o = output.select(F.col(key).alias("key"), F.lit(1).alias("side"), "idx", "word", "start_ms", "end_ms").unionByName(source.select(F.col(key).alias("key"), F.lit(0).alias("side"), "idx", "word", "start_ms", "end_ms"))
    p = plan.select(F.col(key).alias("key"), "ord", "line", "source_start", "source_end", "start", "end")
    kind = p.schema["key"].dataType.simpleString()

    def run(k: tuple, own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out, src = _Heard(words[words["side"] == 1]), _Heard(words[words["side"] == 0])
        within = lambda lo, hi: [out.key[i] for i in range(len(out.key)) if out.start[i] < hi and lo < out.end[i]]
        rows, beats = [], own.sort_values("ord").to_dict("records")
        for n, r in enumerate(beats):
            want = Q.key_words(r["line"])
            s = Q.containment(want, within(max(r["start"] - slack_ms, 0), r["end"] + slack_ms), Q.same_word)
            middle = [src.start[i] + (src.end[i] - src.start[i]) / 2 for i in range(len(src.key))]
            tail = [w for w, m in zip(src.key, middle) if r["source_start"] <= m < r["source_end"]][-2:]
            ending = within(r["end"] - 1300, r["end"] + 300)
            lost = [w for w in tail if not any(Q.same_word(w, x) for x in ending)]
            again: list[str] = []
            if n + 1 < len(beats):
                join = beats[n + 1]["start"] + 200
                head = [w for w, t in zip(out.key, out.start) if join <= t < join + 1500][:5]
                last = [w for w in tail if len(w) >= 4]
                again = [w for w in last if any(Q.same_word(w, x) for x in head)]
                again = again if len(again) == len(last) else []
            rows.append((k[0], r["ord"], s >= LEAST_ALIKE, s, " ".join(lost) if tail and len(lost) == len(tail) else None, " ".join(again) or None))
        return pd.DataFrame(rows, columns=["key", "ord", "heard", "similarity", "chopped", "repeated"])

    return p.groupBy("key").cogroup(o.groupBy("key")).applyInPandas(run, f"key {kind}, ord int, heard boolean, similarity double, chopped string, repeated string").where("ord IS NOT NULL").withColumnRenamed("key", key)


def times_heard(phrases: DataFrame, words: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """How often a phrase (key, phrase) is said in the words: stretches of its length that are alike enough, counted without overlap: key, phrase, times."""

    def kernel(own: list[dict], heard: _Heard) -> list[tuple]:
        out = []
        for r in own:
            want = Q.key_words(r["phrase"])
            masks, n, i = Q.match_masks(want, heard.key, Q.same_word), 0, 0
            while want and i + len(want) <= len(heard.key):
                alike = Q.common_length(len(want), masks, heard.key[i : i + len(want)]) / len(want) >= least
                n, i = n + alike, i + (len(want) if alike else 1)
            out.append((r["phrase"], n))
        return out

    l = phrases.select(F.col(key).alias("key"), "phrase", F.lit(0).alias("ord"))
    return _cogrouped(l, words, key, kernel, "phrase string, times int")


def captions_not_heard(captions: DataFrame, words: DataFrame, key: str, slack_ms: int = 700, least: float = 0.5, width: int = 10_000) -> DataFrame:
    """Captions (key, caption, text, start_ms, end_ms) of which less than half the words are said, in order and by ``same_word``, within the slack around them."""
    from tapewright.operators.intervals import overlap_pairs

    c = captions.select(key, "caption", "text", (F.col("start_ms") - slack_ms).alias("lo"), (F.col("end_ms") + slack_ms).alias("hi"))
    w = words.select(key, "idx", "word", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    j = overlap_pairs(c, w, [key], ("lo", "hi"), ("ws", "we"), width)
    heard = j.groupBy(key, "caption").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("heard"))

    @F.pandas_udf(T.DoubleType())
    def contained(text: pd.Series, said: pd.Series) -> pd.Series:
        keys = lambda s: [Q.word_key(x) for x in s] if s is not None else []
        # a caption without words can't be missed
        return pd.Series([Q.containment(want, keys(s), Q.same_word) if (want := Q.key_words(t)) else None for t, s in zip(text, said)], dtype="float64")

    out = c.join(heard, [key, "caption"], "left").withColumn("contained", contained("text", "heard"))
    return out.where(F.col("contained") < least).select(key, "caption", "text", "contained")


def cohesion_at_gaps(words: DataFrame, key: str, window: int = 40, chunk: int = 4_000) -> DataFrame:
    """How much vocabulary the ``window`` words before each word share with those from it on: key, idx, cohesion. ``idx`` counts a recording's words from 0. Words are taken in
    chunks that also hold the windows on either side."""
    from tapewright.functions import normalise as N

    bare = N.bare(F.col("word"))
    term = F.when((F.length(bare) > 2) & ~bare.isin(N.STOP_WORDS), bare)
    at = F.array_distinct(F.array(F.expr(f"greatest(idx - {window - 1}, 0) div {chunk}"), F.expr(f"idx div {chunk}"), F.expr(f"(idx + {window}) div {chunk}")))
    w = words.select(F.col(key).alias("key"), "idx", term.alias("term")).withColumn("chunk", F.explode(at))

    def kernel(rows: list[dict]) -> list[tuple]:
        first = rows[0]["idx"]
        return [(first + i, s, (first + i) // chunk) for i, s in Q.gap_cohesion([r["term"] for r in rows], window)]

    g = Q.per_group(w, ["key", "chunk"], "idx", kernel, [("at", T.IntegerType()), ("cohesion", T.DoubleType()), ("home", T.LongType())])
    return g.where("home = chunk").select(F.col("key").alias(key), F.col("at").alias("idx"), "cohesion")


def sections(words: DataFrame, key: str, count: int, window: int = 40) -> DataFrame:
    """A recording in at most ``count`` sections: key, section, first_idx; cut where the words on either side are least alike, no closer than a third of a section or
    the window to another cut. Up to two windows of words are one section.

    One cut of every recording is found per round, by an aggregation over its places."""
    from tapewright.session import cut_lineage

    n = words.groupBy(F.col(key).alias("key")).agg((F.max("idx") + 1).cast("int").alias("n"))
    c = cohesion_at_gaps(words, key, window).select(F.col(key).alias("key"), "idx", "cohesion").join(n, "key")
    c = c.where((F.col("n") > 2 * window) & (F.col("idx") < F.col("n") - window)).withColumn("apart", F.greatest(F.call_function("div", F.col("n"), F.lit(3 * count)), F.lit(window)))
    c = cut_lineage(c.select("key", "idx", F.round("cohesion", 12).alias("cohesion"), "apart"))
    cuts = n.select("key", F.lit(0).alias("first_idx"))
    for _ in range(count - 1):
        best = cut_lineage(c.groupBy("key").agg(F.min(F.struct("cohesion", "idx"))["idx"].alias("cut")))
        cuts = cuts.unionByName(best.select("key", F.col("cut").alias("first_idx")))
        c = c.join(best, "key").where(F.abs(F.col("idx") - F.col("cut")) >= F.col("apart")).drop("cut")
    place = F.row_number().over(Window.partitionBy("key").orderBy("first_idx")) - 1
    return cuts.select(F.col("key").alias(key), place.alias("section"), "first_idx")


def label_scores(labels: DataFrame, key: str) -> DataFrame:
    """Predicted against labelled lines of frames (key, truth, predicted: arrays of text): recall and hallucination by mutual containment."""
    norm = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), lambda x: x != "")
    l = labels.select(key, norm(F.col("truth")).alias("t"), norm(F.col("predicted")).alias("p"))
    near = lambda x, xs: F.exists(xs, lambda y: x.contains(y) | y.contains(x))
    found = F.size(F.filter("t", lambda x: near(x, F.col("p"))))
    invented = F.size(F.filter("p", lambda x: ~near(x, F.col("t"))))
    return l.select(key, F.size("t").alias("n_truth"), found.alias("found"), F.size("p").alias("n_predicted"), invented.alias("invented"), F.try_divide(found, F.size("t")).alias("recall"))

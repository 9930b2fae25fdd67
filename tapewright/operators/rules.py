"""The rule engine: checks whose findings block, warn about or hold a delivery.

A rule is a function of the context (named DataFrames and values) that returns findings with one schema. ``verify`` runs a
set of rules and unites their findings in rule order. A rule whose input is missing gives a finding that it could not run: a
check that cannot run is not a pass.

Findings: subject, rule, category, mode ('block', 'warn' or 'hold'), at (BIGINT, may be NULL), detail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.blocked import blocks, following
from tapewright.operators.intervals import HOUR, overlap_pairs, point_in_range

COLUMNS = ["subject", "rule", "category", "mode", "at", "detail"]
SECOND = 10**6

# Severity of the modes, the confidence with which a decision may ship at given stakes, the named devices, what each
# register forbids of them, and the measurements that a proposed check may name.
SEVERITY = {"block": 3, "hold": 2, "warn": 1}
SHIP_CONFIDENCE = {"routine": 0.70, "elevated": 0.85, "high": 0.95, "irreversible": 1.01}
DEVICES = ["whip", "dissolve", "soundOnCut", "comedicTiming", "memeCaption", "speedRamp", "zoomPunch", "jumpCut", "musicBed"]
PROHIBITED = {
    "grave": ["whip", "soundOnCut", "comedicTiming", "memeCaption", "speedRamp", "zoomPunch"],
    "earnest": ["memeCaption", "comedicTiming"],
    "neutral": [],
    "playful": [],
    "irreverent": [],
}
MEASUREMENTS = ["textContrast", "textSafeArea", "textDuration", "subjectInFrame"]


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    mode: str
    needs: tuple[str, ...]
    run: Callable[[dict], DataFrame]


def finding(df: DataFrame, name: str, category: str, mode: Column | str, subject: Column, at: Column | None, detail: Column) -> DataFrame:
    return df.select(
        subject.cast("string").alias("subject"), F.lit(name).alias("rule"), F.lit(category).alias("category"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"), (F.lit(None) if at is NOWHERE else at).cast("bigint").alias("at"), detail.alias("detail")
    )


#: For findings without a place in time.
NOWHERE = None


def verify(rules: Sequence[Rule], context: dict, spark) -> DataFrame:
    """All findings of the rules, with ``rule_ord``. A rule that lacks an input gives one warning that it could not run."""
    out = None
    for n, r in enumerate(rules):
        missing = [x for x in r.needs if context.get(x) is None]
        if missing:
            f = spark.createDataFrame([(None, r.name, r.category, "warn", None, "could not run: no " + ", ".join(missing))], "subject string, rule string, category string, mode string, at bigint, detail string")
        else:
            f = r.run(context)
        f = f.withColumn("rule_ord", F.lit(n))
        out = f if out is None else out.unionByName(f)
    return out


def can_render(findings: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Whether nothing blocks or holds."""
    return findings.groupBy(*keys).agg((F.count_if(F.col("mode").isin("block", "hold")) == 0).alias("can_render"), F.count(F.lit(1)).alias("n_findings"))


# ---- decisions -------------------------------------------------------------------------------------------------------


def every_decision_has_a_basis(applied: DataFrame, decisions: DataFrame) -> DataFrame:
    d = applied.select("decision").distinct().join(decisions.where("basis IS NOT NULL").select("decision"), "decision", "left_anti")
    return finding(d, "every decision has a basis", "provenance", "block", F.col("decision"), NOWHERE, F.lit("no basis"))


def none_below_floor(decisions: DataFrame, floor: float = 0.7) -> DataFrame:
    return finding(decisions.where(F.col("confidence") < floor), "no decision below the floor", "confidence", "block", F.col("decision"), F.col("at"), F.format_string("%.2f", F.col("confidence")))


def safety_is_not_overridden(decisions: DataFrame) -> DataFrame:
    old = decisions.where("basis = 'safety'").select(F.col("decision").alias("old"))
    d = decisions.where("basis <> 'safety' OR basis IS NULL").join(old, F.col("supersedes") == F.col("old"))
    return finding(d, "safety is not overridden", "safety", "block", F.col("decision"), F.col("at"), F.concat(F.lit("supersedes "), F.col("old").cast("string")))


def low_confidence_holds(decisions: DataFrame, floor: float = 0.7, ship: float = 0.85) -> DataFrame:
    d = decisions.where((F.col("confidence") >= floor) & (F.col("confidence") < ship))
    return finding(d, "low confidence holds", "confidence", "hold", F.col("decision"), F.col("at"), F.format_string("%.2f", F.col("confidence")))


def stakes_raise_the_bar(decisions: DataFrame, stakes: str) -> DataFrame:
    d = decisions.where(F.col("confidence") < SHIP_CONFIDENCE[stakes])
    return finding(d, "stakes raise the bar", "brief", "hold", F.col("decision"), F.col("at"), F.format_string("%.2f", F.col("confidence")))


def no_prohibited_device(decisions: DataFrame, register: str, prohibited: Sequence[str] = ()) -> DataFrame:
    d = decisions.where(F.col("kind").isin([*PROHIBITED[register], *prohibited]))
    return finding(d, "no prohibited device", "brief", "block", F.col("decision"), F.col("at"), F.col("kind"))


def required_devices_are_used(decisions: DataFrame, required: DataFrame) -> DataFrame:
    d = required.join(decisions.select(F.col("kind").alias("device")).distinct(), "device", "left_anti")
    return finding(d, "required devices are used", "brief", "warn", F.col("device"), NOWHERE, F.lit("not used"))


def compile_brief(rules: DataFrame, text: str) -> DataFrame:
    """House rules with the first device they name (NULL: can't be checked)."""
    low = F.lower(F.col(text))
    device = F.coalesce(*[F.when(low.contains(d.lower()), F.lit(d)) for d in DEVICES])
    return rules.withColumn("device", device).withColumn("checkable", device.isNotNull())


def brief_can_be_contradicted(intent: DataFrame, text: str, subject: str) -> DataFrame:
    """Intents of fewer than three words can't be checked."""
    i = intent.where(F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(\S+)"), F.lit(1))) < 3)
    return finding(i, "brief can be contradicted", "brief", "warn", F.col(subject), NOWHERE, F.lit("intent too short"))


# ---- clips -----------------------------------------------------------------------------------------------------------


def clips_do_not_overlap(clips: DataFrame) -> DataFrame:
    """Neighbours on a track, as sorted by start."""
    c = following(blocks(clips, "start", HOUR), ["doc", "track"], "__block", ["start", "end", "clip"], "start", "nxt").where("nxt.value < end")
    return finding(c, "clips do not overlap", "structure", "block", F.col("doc"), F.col("nxt.value"), F.concat(F.lit("clip "), F.col("clip").cast("string")))


def clips_are_on_the_grid(clips: DataFrame, grid: Column) -> DataFrame:
    c = clips.withColumn("grid", grid).select("doc", "clip", "grid", F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("start").alias("at")), F.struct(F.lit("end").alias("edge"), F.col("end").alias("at")))).alias("x"))
    c = c.where(F.pmod(F.col("x.at"), F.col("grid")) != 0)
    return finding(c, "clips are on the grid", "structure", "block", F.col("doc"), F.col("x.at"), F.concat(F.col("x.edge"), F.lit(" of clip "), F.col("clip").cast("string")))


def no_short_shot(clips: DataFrame, least: int = SECOND // 5) -> DataFrame:
    c = clips.where((F.col("track") == 0) & (F.col("end") - F.col("start") < least))
    return finding(c, "no shot is too short", "pacing", "warn", F.col("doc"), F.col("start"), F.concat((F.col("end") - F.col("start")).cast("string"), F.lit(" us")))


def sources_are_within_assets(clips: DataFrame, assets: DataFrame) -> DataFrame:
    """``assets``: asset, duration (NULL: unknown, which is no fault). A missing asset is one."""
    a = assets.select(F.col("asset").alias("a_asset"), F.col("duration"))
    j = clips.join(a, F.col("asset") == F.col("a_asset"), "left")
    why = F.when(F.col("a_asset").isNull(), "no such asset").when(F.col("source_end") > F.col("duration"), "past the end")
    j = j.withColumn("why", why).where("why IS NOT NULL")
    return finding(j, "sources are within their assets", "structure", "block", F.col("doc"), F.col("start"), F.col("why"))


def timeline_is_not_empty(docs: DataFrame, clips: DataFrame) -> DataFrame:
    return finding(docs.select("doc").distinct().join(clips.select("doc"), "doc", "left_anti"), "timeline is not empty", "structure", "block", F.col("doc"), NOWHERE, F.lit("no clips"))


# ---- sound -----------------------------------------------------------------------------------------------------------


def loudness_within_target(readings: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``readings``: doc, integrated, target. No target passes; a target without a measurement does not."""
    r = readings.where(F.col("target").isNotNull() & (F.col("integrated").isNull() | (F.abs(F.col("integrated") - F.col("target")) > tolerance)))
    return finding(r, "loudness within target", "sound", "block", F.col("doc"), NOWHERE, F.when(F.col("integrated").isNull(), "not measured").otherwise(F.format_string("%.2f LUFS", F.col("integrated"))))


def true_peak_below_ceiling(readings: DataFrame) -> DataFrame:
    """A missing peak passes, with a warning that says so."""
    r = readings.where(F.col("ceiling").isNotNull() & (F.col("peak").isNull() | (F.col("peak") > F.col("ceiling"))))
    return finding(r, "true peak below ceiling", "sound", F.when(F.col("peak").isNull(), "warn").otherwise("block"), F.col("doc"), NOWHERE, F.when(F.col("peak").isNull(), "not measured").otherwise(F.format_string("%.2f dBTP", F.col("peak"))))


# ---- perception ------------------------------------------------------------------------------------------------------


def cut_instants(clips: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """doc, track, clip, at (on the timeline) and source_at: the join at the head of each clip that doesn't begin at 0 is a cut, and the
    source instant is where it resumes. ``kinds`` (doc, track, kind): only video and audio tracks count."""
    c = clips.where("start > 0")
    if kinds is not None:
        c = c.join(kinds.where(F.col("kind").isin("video", "audio")).select("doc", "track").distinct(), ["doc", "track"], "left_semi")
    return c.select("doc", "track", "clip", "asset", F.col("start").alias("at"), F.col("source_start").alias("source_at"))


def no_cut_inside_a_word(cuts: DataFrame, words: DataFrame, slack: int, width: int, longest: int | None = None) -> DataFrame:
    """``cuts``: doc, at; ``words``: doc, idx, start, end: a cut more than ``slack`` from both edges of the word it falls in. ``longest``: the
    longest word, if it is known."""
    # words are many more than their texts' size lets Spark believe: never broadcast
    w = words.select("doc", "idx", F.col("start").alias("w_start"), F.col("end").alias("w_end")).hint("merge")
    j = point_in_range(cuts.select("doc", "at").distinct(), w, ["doc"], "at", "w_start", "w_end", ["w_start", "idx"], width, longest)
    j = j.where((F.col("at") - F.col("w_start") > slack) & (F.col("w_end") - F.col("at") > slack))
    return finding(j, "no cut inside a word", "speech", "block", F.col("doc"), F.col("at"), F.concat(F.lit("word "), F.col("idx").cast("string")))


def cuts_rest_on_confident_words(cuts: DataFrame, words: DataFrame, reach: int, least: int, width: int) -> DataFrame:
    """The least sure word with an edge within ``reach`` of a cut, if it is under ``least`` (confidence in hundredths)."""
    # the reach is laid around the cuts, which are fewer than the edges; those are never broadcast
    edges = words.select("doc", "idx", "conf", F.explode(F.array("start", "end")).alias("edge")).withColumn("edge_end", F.col("edge") + 1).hint("merge")
    c = cuts.select("doc", "at").distinct().withColumn("lo", F.col("at") - reach).withColumn("hi", F.col("at") + reach + 1)
    j = overlap_pairs(c, edges, ["doc"], ("lo", "hi"), ("edge", "edge_end"), width, 2 * reach + 1)
    worst = j.groupBy("doc", "at").agg(F.min(F.struct("conf", "idx")).alias("w")).where(F.col("w.conf") < least)
    return finding(worst, "cuts rest on confident words", "speech", "hold", F.col("doc"), F.col("at"), F.concat(F.lit("word "), F.col("w.idx").cast("string")))


def text_is_inside_the_safe_area(lines: DataFrame, width: int, height: int, share: float = 0.9) -> DataFrame:
    """``lines``: subject, at, line, box. The first offence of each line: a box that leaves the middle ``share`` of the picture."""
    mx, my = width * (1 - share) / 2, height * (1 - share) / 2
    b = F.col("box")
    out = (b["x"] < mx) | (b["y"] < my) | (b["x"] + b["width"] > width - mx) | (b["y"] + b["height"] > height - my)
    f = lines.where(out).groupBy("subject", "line").agg(F.min("at").alias("at"))
    return finding(f, "text is inside the safe area", "text", "warn", F.col("subject"), F.col("at"), F.col("line"))


def text_is_readable(shown: DataFrame, per_word: int = 3 * SECOND // 10) -> DataFrame:
    """``shown``: subject, line, on_screen: less time than its words take to read."""
    n = F.size(F.regexp_extract_all("line", F.lit(r"(\S+)"), F.lit(1)))
    s = shown.where(F.col("on_screen") < n * per_word)
    return finding(s, "text is on screen long enough", "text", "warn", F.col("subject"), NOWHERE, F.col("line"))


def cuts_fall_on_shot_boundaries(cuts: DataFrame, shots: DataFrame, slack: int, width: int) -> DataFrame:
    """Cuts inside a shot, more than ``slack`` from both its edges; recordings with one shot aren't judged."""
    many = shots.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    s = shots.join(many, "doc").select("doc", F.col("shot").alias("shot"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    j = point_in_range(cuts.select("doc", "at").distinct(), s, ["doc"], "at", "s_start", "s_end", ["s_start", "shot"], width)
    j = j.where((F.col("at") - F.col("s_start") > slack) & (F.col("s_end") - F.col("at") > slack))
    return finding(j, "cuts fall on shot boundaries", "picture", "warn", F.col("doc"), F.col("at"), F.concat(F.lit("shot "), F.col("shot").cast("string")))


def text_has_contrast(lines: DataFrame, least: float = 3.0) -> DataFrame:
    """``lines``: subject, at, line, ratio: the first offence of each line."""
    f = lines.where(F.col("ratio") < least).groupBy("subject", "line").agg(F.min("at").alias("at"))
    return finding(f, "text has enough contrast", "text", "warn", F.col("subject"), F.col("at"), F.col("line"))


def claim_standing(shot: Column, n_faces: Column) -> Column:
    """A claim about the picture against the faces seen: contradicted, corroborated, or unchecked where nothing was looked for."""
    return (
        F.when(n_faces.isNull() | (n_faces < 0), "unchecked")
        .when((shot == "card") & (n_faces > 0), "contradicted")
        .when(shot.isin("closeUp", "splitScreen") & (n_faces == 0), "contradicted")
        .when(shot.isin("card", "closeUp", "splitScreen"), "corroborated")
        .otherwise("unchecked")
    )


def index_refusal(unparseable: Column, abstained: Column) -> Column:
    """Why an index of answers is refused: shares over all its rows; NULL if it isn't."""
    return F.when(unparseable > 0.25, "unparseable").when(abstained > 0.5, "abstained")


def proposal_rejection(kind: Column, at: Column, looked: Column, gap: Column, n_lines: Column, n_faces: Column) -> Column:
    """Why a proposed check isn't compiled: reasons in order; NULL if it is.

    ``looked``: whether the piece was looked at; ``gap`` (microseconds, NULL: nothing seen), ``n_lines`` and ``n_faces`` of the nearest
    observation. A proposal without a time holds for the whole piece."""
    there = (
        F.when(gap.isNull(), "nothing was observed")
        .when(gap > SECOND, "too far from what was observed")
        .when(kind.startswith("text") & ~(n_lines > 0), "no text to measure")
        .when((kind == "subjectInFrame") & ~(n_faces > 0), "no subject to measure")
    )
    return F.when(~kind.isin(MEASUREMENTS), "no such measurement").when(~looked, "not looked at").when(at.isNotNull(), there)


def predicted_against_achieved(pairs: DataFrame) -> DataFrame:
    """``pairs``: doc, frames, achieved_frames, distinct, repeats, illegal, black, loudness, achieved_loudness, silent: one row per disagreement.

    Repeats count only where frames are expected to differ; a silent result isn't compared for loudness.
    """
    checks = F.array(
        F.when(F.col("frames") != F.col("achieved_frames"), "frames"),
        F.when(F.col("distinct") & (F.col("repeats") > 0), "repeats"),
        F.when(F.col("illegal") > 0, "levels"),
        F.when(F.col("black") > 0, "black"),
        F.when(~F.col("silent") & (F.abs(F.col("loudness") - F.col("achieved_loudness")) > 0.5), "loudness"),
    )
    return pairs.select("doc", F.explode(F.array_compact(checks)).alias("disagrees"))


def reference_differences(pairs: DataFrame) -> DataFrame:
    """How bands of an output fail to look like those of a reference, a row each.

    ``pairs``: doc, band, face and ref_face (height in the band, NULL: no face), faceless_run and ref_faceless_run (seconds), captions and
    ref_captions (share of frames, NULL: none), label and ref_label (whether there is one)."""
    ratio = F.when(F.col("ref_face").isNotNull(), F.col("face") / F.greatest(F.col("ref_face"), F.lit(0.001)))
    wanted = F.col("ref_captions") > 0.5
    checks = F.array(
        F.when(F.col("ref_label") & ~F.col("label"), "no label"),
        F.when((ratio < 0.7) | (ratio > 1.4), "face size"),
        F.when(F.col("ref_face").isNotNull() & F.col("face").isNull(), "no face"),
        F.when(F.coalesce("faceless_run", F.lit(0.0)) > F.greatest(F.coalesce("ref_faceless_run", F.lit(0.0)), F.lit(1.0)) + 0.5, "longer without a face"),
        F.when(wanted & F.col("captions").isNull(), "no captions").when(wanted & (F.col("captions") < F.col("ref_captions") * 0.5), "fewer captions"),
    )
    return pairs.select("doc", "band", F.explode(F.array_compact(checks)).alias("differs"))


def render_problem(faces: Column, source_faces: Column, aspect: Column, intended: Column, decoded: Column) -> Column:
    return F.when(decoded == 0, "nothing decoded").when(source_faces - faces > 0.35, "faces lost").when(F.abs(aspect - intended) > 0.02, "wrong aspect")


def unsafe_source(body: Column, forbidden: Sequence[str]) -> Column:
    """Why authored source is refused: a forbidden token, braces that don't balance or close before they open, or no return; NULL if it isn't."""
    signs = F.split(F.regexp_replace(body, r"[^{}]", ""), "")
    step = lambda acc, c: F.when(acc < 0, acc).otherwise(acc + F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    depth = F.aggregate(signs, F.lit(0), step)
    token = F.coalesce(*[F.when(body.contains(t), F.lit(f"forbidden: {t}")) for t in forbidden])
    return F.coalesce(token, F.when(depth != 0, "unbalanced braces").when(~body.contains("return"), "no return"))


# ---- review ----------------------------------------------------------------------------------------------------------


def review_items(findings: DataFrame, window: int = 2 * SECOND) -> DataFrame:
    """Located findings as ranges to look at, half the window on either side and not before 0; severity 3, 2, 1."""
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    half = window // 2
    return findings.where("at IS NOT NULL").select("subject", F.element_at(sev, F.col("mode")).alias("severity"), F.greatest(F.col("at") - half, F.lit(0)).alias("start"), (F.col("at") + half).alias("end"), F.col("detail").alias("reason"))


# ---- sets of rules ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Brief:
    """How a piece should carry itself: what its register and stakes ask for, devices forbidden and required beside them."""

    register: str
    stakes: str
    prohibited: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


def standard_rules(frame: int = SECOND // 25, ship: float = 0.85) -> list[Rule]:
    """The 11 rules of every document. Inputs: applied, decisions, docs, clips (doc, track, clip, asset, source_start, source_end, start, end), assets and
    readings; the grid is ``frame`` units."""
    return [
        Rule("every decision has a basis", "provenance", "block", ("applied", "decisions"), lambda c: every_decision_has_a_basis(c["applied"], c["decisions"])),
        Rule("no decision below the floor", "confidence", "block", ("decisions",), lambda c: none_below_floor(c["decisions"])),
        Rule("safety is not overridden", "safety", "block", ("decisions",), lambda c: safety_is_not_overridden(c["decisions"])),
        Rule("clips do not overlap", "structure", "block", ("clips",), lambda c: clips_do_not_overlap(c["clips"])),
        Rule("clips are on the grid", "structure", "block", ("clips",), lambda c: clips_are_on_the_grid(c["clips"], F.lit(frame))),
        Rule("no shot is too short", "pacing", "warn", ("clips",), lambda c: no_short_shot(c["clips"])),
        Rule("sources are within their assets", "structure", "block", ("clips", "assets"), lambda c: sources_are_within_assets(c["clips"], c["assets"])),
        Rule("timeline is not empty", "structure", "block", ("docs", "clips"), lambda c: timeline_is_not_empty(c["docs"], c["clips"])),
        Rule("loudness within target", "sound", "block", ("readings",), lambda c: loudness_within_target(c["readings"])),
        Rule("true peak below ceiling", "sound", "block", ("readings",), lambda c: true_peak_below_ceiling(c["readings"])),
        Rule("low confidence holds", "confidence", "hold", ("decisions",), lambda c: low_confidence_holds(c["decisions"], ship=ship)),
    ]


def brief_rules(brief: Brief) -> list[Rule]:
    """The four rules a brief compiles to. Inputs: decisions, and intents (subject, intent)."""

    def required(c: dict) -> DataFrame:
        wanted = c["decisions"].sparkSession.createDataFrame([(d,) for d in brief.required], "device string")
        return required_devices_are_used(c["decisions"], wanted)

    return [
        Rule("no prohibited device", "brief", "block", ("decisions",), lambda c: no_prohibited_device(c["decisions"], brief.register, brief.prohibited)),
        Rule("required devices are used", "brief", "warn", ("decisions",), required),
        Rule("stakes raise the bar", "brief", "hold", ("decisions",), lambda c: stakes_raise_the_bar(c["decisions"], brief.stakes)),
        Rule("brief can be contradicted", "brief", "warn", ("intents",), lambda c: brief_can_be_contradicted(c["intents"], "intent", "subject")),
    ]


def perception_rules(width: int = 1920, height: int = 1080) -> list[Rule]:
    """The five rules that perception makes checkable. Inputs: cuts (doc, at: source instants, microseconds), words, lines, shown and shots."""
    return [
        Rule("no cut inside a word", "speech", "block", ("cuts", "words"), lambda c: no_cut_inside_a_word(c["cuts"], c["words"], SECOND // 50, 2 * SECOND)),
        Rule("cuts rest on confident words", "speech", "hold", ("cuts", "words"), lambda c: cuts_rest_on_confident_words(c["cuts"], c["words"], SECOND // 2, 70, 2 * SECOND)),
        Rule("text is inside the safe area", "text", "warn", ("lines",), lambda c: text_is_inside_the_safe_area(c["lines"], width, height)),
        Rule("text is on screen long enough", "text", "warn", ("shown",), lambda c: text_is_readable(c["shown"])),
        Rule("cuts fall on shot boundaries", "picture", "warn", ("cuts", "shots"), lambda c: cuts_fall_on_shot_boundaries(c["cuts"], c["shots"], 3 * SECOND // 10, 20 * SECOND)),
    ]


def rules_for(brief: Brief | None = None, perception: bool = False) -> list[Rule]:
    """11 rules, 15 with a brief, 16 with perception, 20 with both."""
    return [*standard_rules(), *(brief_rules(brief) if brief else []), *(perception_rules() if perception else [])]

"""The editor's report on a recording and the plan for editing one in the format of another: rules over the facts of each, one row per finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delivery loudness (LUFS), the ceiling of true peaks (dBTP), the least range (LU) and separation of speech from room (dB), the longest unbroken
# stretch of speech (s), short and long median shots (s), when a shot stalls (times the median, s), and for formats the vocabulary shared across
# the clearest break and how much slower a delivery may be.
TARGETS = {"streaming": -14.0, "EBU R128": -23.0}
PEAK_CEILING, LEAST_RANGE, LEAST_SEPARATION = -1.0, 3.0, 20.0
LONGEST_STRETCH = 12.0
FAST_SHOT, LONG_SHOT, STALL_TIMES, STALL_SECONDS = 1.5, 8.0, 4, 10.0
CLEAR_BREAK, SLOWER = 0.28, 0.85


def findings_of(facts: DataFrame, subject: str, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """``rules``: kind, layer, condition, text. All rules are evaluated in one pass over the facts; a condition that is NULL gives no finding."""
    rows = F.array(*[F.when(cond, F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), text.alias("text"))) for n, (kind, layer, cond, text) in enumerate(rules)])
    return facts.select(subject, F.explode(F.array_compact(rows)).alias("x")).select(subject, "x.ord", "x.kind", "x.layer", "x.text")


def editors_report(facts: DataFrame, subject: str) -> DataFrame:
    """Facts, opportunities and problems of recordings, in the order of the rules (``ord``).

    ``facts``: has_video, has_audio, width, height, seconds; integrated, loudness_range, true_peak, speech_level, noise_floor, silences, silent_seconds,
    longest_silence and sound_measured; words, segments, fillers, filler_seconds, unsure_words, longest_segment; shots, median_shot, longest_shot; samples, with_face, with_hands,
    with_text, distinct_lines, person_runs. NULL: not measured, so nothing is said about it.
    """
    f, lit = F.col, F.lit
    fixed = lambda c, n=1: F.format_string(f"%.{n}f", c.cast("double"))
    tenths = lambda c: F.concat(F.floor(c).cast("string"), lit("."), (F.floor(c * 10) % 10).cast("string"))
    whole = lambda c: F.floor(c).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])
    share = lambda c: F.floor(100 * f(c) / f("samples")).cast("string")
    has_sound, seen = F.coalesce(f("has_audio"), lit(False)), f("samples") > 0
    measured = has_sound & F.coalesce(f("sound_measured"), lit(False))
    distance = [say(name, " ", F.format_string("%+.1f", lit(t) - f("integrated"))) for name, t in TARGETS.items()]
    apart = f("speech_level") - f("noise_floor")
    many = f("shots") > 1
    return findings_of(
        facts,
        subject,
        [
            ("fact", "L0", F.coalesce(f("has_video"), lit(False)) & f("seconds").isNotNull(), say("picture, ", tenths(f("seconds")), " s")),
            ("fact", "L0", f("has_video") & (f("height") > f("width")), lit("portrait")),
            ("problem", "L0", ~has_sound, lit("no sound track")),
            ("fact", "L1", measured & f("integrated").isNotNull(), say(fixed(f("integrated")), " LUFS, range ", fixed(f("loudness_range")), " LU, peak ", fixed(f("true_peak")), " dBTP")),
            ("fact", "L1", measured & f("integrated").isNotNull(), say("to targets: ", F.concat_ws(", ", *distance))),
            ("problem", "L1", measured & f("integrated").isNotNull() & (f("true_peak") > PEAK_CEILING), say("peak over ", fixed(lit(PEAK_CEILING), 0), " dBTP")),
            ("opportunity", "L1", measured & f("integrated").isNotNull() & (f("loudness_range") < LEAST_RANGE), lit("little dynamic range")),
            ("problem", "L1", measured & f("integrated").isNull(), lit("silent track")),
            ("fact", "L1", measured & apart.isNotNull(), say("speech ", fixed(apart, 0), " dB over the room")),
            ("problem", "L1", measured & (apart < LEAST_SEPARATION), lit("too little separation")),
            ("opportunity", "L1", measured & (f("silences") > 0), say(f("silences").cast("string"), " silences, ", tenths(f("silent_seconds")), " s")),
            ("opportunity", "L1", measured & (f("silences") > 0), say("longest gap ", tenths(f("longest_silence")), " s")),
            ("fact", "L2", has_sound & f("words").isNotNull(), say(f("words").cast("string"), " words, ", F.floor(f("words") / F.greatest(f("seconds"), lit(0.001)) * 60).cast("string"), " a minute")),
            ("fact", "L2", has_sound & f("segments").isNotNull(), say(f("segments").cast("string"), " segments")),
            ("opportunity", "L2", has_sound & (f("fillers") > 0), say(f("fillers").cast("string"), " fillers")),
            ("problem", "L2", has_sound & (f("unsure_words") > 0), say(f("unsure_words").cast("string"), " words below the floor")),
            ("opportunity", "L2", has_sound & (f("longest_segment") > LONGEST_STRETCH), say("unbroken for ", whole(f("longest_segment")), " s")),
            ("fact", "L2", f("shots") == 1, lit("one continuous shot")),
            ("fact", "L2", many, say(f("shots").cast("string"), " shots, median ", tenths(f("median_shot")), " s")),
            ("fact", "L2", many & (f("median_shot") < FAST_SHOT), lit("fast cutting")),
            ("opportunity", "L2", many & (f("median_shot") > LONG_SHOT), lit("long takes")),
            ("opportunity", "L2", many & (f("longest_shot") > F.greatest(f("median_shot") * STALL_TIMES, lit(STALL_SECONDS))), say("one shot runs ", whole(f("longest_shot")), " s")),
            ("fact", "L2", seen, say("a person in ", share("with_face"), " %")),
            ("fact", "L2", seen & (f("with_hands") > 0), say("hands in ", share("with_hands"), " %")),
            ("fact", "L2", seen & (f("with_text") > 0), say("text in ", share("with_text"), " %, ", f("distinct_lines").cast("string"), " lines")),
            ("fact", "L2", seen & (f("person_runs") > 1), say("a person in ", f("person_runs").cast("string"), " runs")),
            ("problem", "L2", seen & (f("with_face") == 0) & (f("with_text") == 0), lit("neither face nor text")),
        ],
    )


def format_plan(pairs: DataFrame, subject: str) -> DataFrame:
    """How to edit a recording in the format of a reference: kinds 'step', 'question' (for a human) and 'unknown' (what can't be told), in the order of the rules.

    ``pairs``: panels (1: no split) and opening_seconds (NULL: none) of the reference, weakest_break (shared vocabulary across the least clear boundary of
    the recording's sections), repeated (lines said again, perhaps on purpose), retaken, wpm and ref_wpm, ref_loudness, echo_known. NULL: not measured.
    """
    f, lit = F.col, F.lit
    split = F.coalesce(f("panels") > 1, lit(False))
    echo = F.coalesce(f("echo_known"), lit(False))
    number = lambda c, n=0: F.format_string(f"%.{n}f", f(c).cast("double")) if n else F.floor(f(c)).cast("string")
    return findings_of(
        pairs,
        subject,
        [
            ("step", "layout", split, F.concat(lit("split into "), f("panels").cast("string"), lit(" panels"))),
            ("step", "layout", ~split, lit("single frame")),
            ("step", "layout", f("opening_seconds").isNotNull(), F.concat(lit("open together for "), number("opening_seconds", 1), lit(" s"))),
            ("question", "content", f("weakest_break") > CLEAR_BREAK, lit("no clear division: where should it be cut?")),
            ("step", "content", split, lit("label the panels by section")),
            ("question", "takes", f("repeated") > 0, F.concat(f("repeated").cast("string"), lit(" lines are said again: on purpose?"))),
            ("step", "takes", f("retaken") > 0, F.concat(lit("use the best of "), f("retaken").cast("string"), lit(" retaken lines"))),
            ("step", "pace", f("wpm") < f("ref_wpm") * SLOWER, F.concat(lit("tighten pauses: "), number("wpm"), lit(" to "), number("ref_wpm"), lit(" words a minute"))),
            ("step", "pace", f("wpm") >= f("ref_wpm") * SLOWER, lit("keep the pace")),
            ("step", "sound", f("ref_loudness").isNotNull(), F.concat(lit("match "), number("ref_loudness", 1), lit(" LUFS"))),
            ("step", "captions", lit(True), lit("burn in captions")),
            ("unknown", "look", lit(True), lit("fonts and colours")),
            ("unknown", "layout", ~echo, lit("delay between panels")),
            ("unknown", "look", lit(True), lit("graphics that aren't text")),
            ("question", "layout", split & ~echo, lit("how long should the echo be?")),
        ],
    )

"""Sequence alignment and the greedy, order-dependent searches over words, as kernels per recording or window.

The kernels are plain functions; the DataFrame operators below them run one per group with Arrow batches. Groups are time windows
where the semantics allow (the vote of two engines) and recordings otherwise. Searches over pairs use exact bounds to skip
what can't qualify, never a cap on candidates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# ---- alignment -------------------------------------------------------------------------------------------------------


def lcs_table(a: Sequence, b: Sequence, match: Callable | None = None) -> list[list[int]]:
    """Lengths of the longest common subsequences of the suffixes."""
    same = match or (lambda x, y: x == y)
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = t[i], t[i + 1]
        x = a[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if same(x, b[j]) else max(below[j], row[j + 1])
    return t


def matched_indices(a: Sequence, b: Sequence) -> list[int]:
    """Indices of ``a`` on the common subsequence found forward; on a tie ``a`` is skipped."""
    t, i, j, out = lcs_table(a, b), 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def match_masks(a: Sequence, others: Sequence, match: Callable | None = None) -> dict:
    """For each distinct word of ``others`` the places in ``a`` that match it, as bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    if match is None:
        return {y: where.get(y, 0) for y in set(others)}
    return {y: sum(bits for x, bits in where.items() if match(x, y)) for y in set(others)}


def common_length(n: int, masks: dict, others: Sequence) -> int:
    """Length of the longest common subsequence with the n words behind the masks: a column of the table in the bits of one number."""
    full = (1 << n) - 1
    row = full
    for y in others:
        hit = row & masks[y]
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def similarity(a: Sequence, b: Sequence, match: Callable | None = None) -> float:
    """Common subsequence over the longer length; 0 of nothing."""
    return common_length(len(a), match_masks(a, b, match), b) / max(len(a), len(b)) if a and b else 0.0


def containment(want: Sequence, heard: Sequence, match: Callable | None = None) -> float:
    """Share of the wanted words heard in order."""
    return similarity(want, heard, match) * max(len(want), len(heard)) / len(want) if want else 0.0


def word_errors(reference: Sequence, hypothesis: Sequence) -> int:
    """Edit distance of two sequences of words, a column of the table in the bits of one number."""
    if not reference:
        return len(hypothesis)
    masks = match_masks(reference, hypothesis)
    last, full = 1 << len(reference) - 1, (1 << len(reference)) - 1
    up, down, distance = full, 0, len(reference)
    for w in hypothesis:
        same = masks[w]
        diagonal = (((same & up) + up) ^ up) | same | down
        h_up, h_down = down | ~(diagonal | up), up & diagonal
        distance += bool(h_up & last) - bool(h_down & last)
        h_up, h_down = (h_up << 1 | 1) & full, h_down << 1 & full
        up, down = (h_down | ~(same | down | h_up)) & full, h_up & (same | down)
    return distance


_EDGES = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")
_NO_KEY = regex.compile(r"[^\p{L}\p{N} ]+")


def trimmed(word: str) -> str:
    """Lower case, without what isn't a letter or digit at the ends."""
    return _EDGES.sub("", word.lower())


def word_key(word: str) -> str:
    """Lower case, only letters and digits."""
    return _NO_KEY.sub("", word.lower()).strip(" ")


def key_words(text: str | None) -> list[str]:
    """The words of a text in lower case, only letters and digits."""
    return [w for w in _NO_KEY.sub("", (text or "").lower()).split(" ") if w]


def _stem(word: str) -> str:
    for ending in ("ing", "ed", "es", "s"):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


@lru_cache(maxsize=262_144)
def same_word(a: str, b: str) -> bool:
    """Equal, of equal stems, or both of four letters or more and within a quarter of the longer one's length in edits."""
    if a == b or _stem(a) == _stem(b):
        return True
    room = max(1, max(len(a), len(b)) // 4)
    return min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= room and word_errors(a, b) <= room


# ---- kernels ---------------------------------------------------------------------------------------------------------


SHORTEST, LONGEST = 2, 12


def best_corrections(words: list[str], start: list[int], end: list[int], upto: int | None = None, least: float = 0.7, gap_ms: int = 2500, shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, int, int, float]]:
    """(place, length of the run there, length of the run behind it, similarity) of the best pair of neighbouring runs at every place (below ``upto``) that has one.

    Runs have 2 to 12 words, the longer ones first; a later pair must beat the best by more than 0.001. Counts of common words bound the
    similarity."""
    w = [word_key(x) for x in words]
    out, n = [], len(w)
    for i in range(min(n - 2 * shortest + 1, n if upto is None else upto)):
        best: tuple[float, int, int] | None = None
        for size in range(min(longest, n - i - shortest), shortest - 1, -1):
            mid = i + size
            if start[mid] - end[mid - 1] > gap_ms:
                continue
            first = Counter(w[i:mid])
            common, held = 0, Counter()
            bounds = []
            for k in range(min(longest, n - mid)):
                x = w[mid + k]
                held[x] += 1
                common += held[x] <= first.get(x, 0)
                bounds.append(common)
            for other in range(len(bounds), shortest - 1, -1):
                top = max(size, other)
                if bounds[other - 1] < least * top - 1e-9 or (best and bounds[other - 1] / top <= best[0] + 0.001):
                    continue
                s = similarity(w[i:mid], w[mid : mid + other])
                if s >= least and (best is None or s > best[0] + 0.001):
                    best = (s, size, other)
        if best:
            out.append((i, best[1], best[2], best[0]))
    return out


def greedy_corrections(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """(first, last of the abandoned run, first, last of the kept one, similarity), from the left; the search goes on at the kept run."""
    out, at = [], 0
    for i, size, other, s in found:
        if i >= at:
            out.append((i, i + size - 1, i + size, i + size + other - 1, s))
            at = i + size
    return out


def self_corrections(words: list[str], start: list[int], end: list[int]) -> list[tuple[int, int, int, int, float]]:
    return greedy_corrections(best_corrections(words, start, end))


def leader_groups(lines: list[list[str]], least: float = 0.72) -> list[int]:
    """Greedy grouping: each line joins the first earlier leader it is similar enough to, or leads a group of its own; not transitive.

    Only leaders that share enough words can qualify (the common subsequence is no longer than the common words), so the others
    are never compared.
    """
    leaders: list[int] = []
    counts = [Counter(x) for x in lines]
    by_word: dict[str, list[int]] = defaultdict(list)
    group = []
    for k, line in enumerate(lines):
        shared: Counter = Counter()
        for w, n in counts[k].items():
            for g in by_word.get(w, ()):
                shared[g] += min(n, counts[leaders[g]][w])
        found = -1
        for g in sorted(shared):
            other = lines[leaders[g]]
            if shared[g] >= least * max(len(line), len(other)) - 1e-9 and similarity(other, line) >= least:
                found = g
                break
        if found < 0:
            found = len(leaders)
            leaders.append(k)
            for w in counts[k]:
                by_word[w].append(found)
        group.append(found)
    return group


def count_passes(order: list[int], groups: int) -> int:
    """How many times the groups are gone through: a pass ends when, after reaching a third of them, one of the first tenth comes again."""
    low, high = max(1, groups // 10), max(2, groups // 3)
    passes, top = (1, -1) if order else (0, -1)
    for g in order:
        if top >= high and g <= low:
            passes, top = passes + 1, g
        top = max(top, g)
    return passes


def caption_groups(words: list[str], start: list[int], end: list[int], size: int = 4, breath_ms: int = 350) -> list[int]:
    """Caption number of each word: a caption ends when it is full, at a final mark, or before a pause."""
    out, n, held = [], 0, 0
    for i, w in enumerate(words):
        out.append(n)
        held += 1
        if held >= size or w[-1:] in ".?!" or (i + 1 < len(words) and start[i + 1] - end[i] >= breath_ms):
            n, held = n + 1, 0
    return out


def gap_cohesion(terms: list[str | None], window: int) -> list[tuple[int, float]]:
    """(i, cosine of the term counts of the ``window`` words before word i and from it on) for every i that has so many on both sides; 0 where either has no terms. The
    counts slide along, so each step costs the same."""
    if len(terms) < 2 * window:
        return []
    before, after = Counter(t for t in terms[:window] if t), Counter(t for t in terms[window : 2 * window] if t)
    dot = sum(n * after[t] for t, n in before.items())
    nb, na = sum(n * n for n in before.values()), sum(n * n for n in after.values())
    out = []
    for i in range(window, len(terms) - window + 1):
        out.append((i, dot / (nb * na) ** 0.5 if nb and na else 0.0))
        gone, moved, new = terms[i - window], terms[i], terms[i + window] if i + window < len(terms) else None
        if moved:  # leaves the words behind, joins those before
            dot -= before[moved]
            na -= 2 * after[moved] - 1
            after[moved] -= 1
            dot += after[moved]
            nb += 2 * before[moved] + 1
            before[moved] += 1
        if gone:
            dot -= after[gone]
            nb -= 2 * before[gone] - 1
            before[gone] -= 1
        if new:
            dot += before[new]
            na += 2 * after[new] + 1
            after[new] += 1
    return out


def locate_line(want: list[str], heard: list[str], closes: Sequence[bool], least: float = 0.45) -> tuple[int, int, float] | None:
    """The stretch of heard words most like a line, by ``same_word``: first, last, similarity; None if nothing is alike at all.

    Every start and the lengths n, 1.5 n + 1 and 0.7 n (two words at least) are tried; the first of equals wins. Where it is alike enough (``least``)
    the stretch is trimmed to words of the line, and at its front to one that doesn't close a sentence (``closes``). How many words of
    a stretch match any of the line bounds its similarity, so most stretches are passed over.
    """
    n = len(want)
    if not n or len(heard) < 2:
        return None
    masks = match_masks(want, heard, same_word)
    known = [0]
    for w in heard:
        known.append(known[-1] + bool(masks[w]))
    sizes = sorted({n, n * 3 // 2 + 1, max(n * 7 // 10, 2)})
    best: tuple[float, int, int] | None = None
    for i in range(len(heard) - 1):
        for size in sizes:
            end = min(i + size, len(heard))
            if end - i < 2:
                continue
            bound = min(known[end] - known[i], n) / max(n, end - i)
            if bound > (best[0] if best else 0.0):
                s = common_length(n, masks, heard[i:end]) / max(n, end - i)
                if s > (best[0] if best else 0.0):
                    best = (s, i, end - 1)
    if best is None:
        return None
    s, a, z = best
    if s >= least:
        while a < z and (not masks[heard[a]] or closes[a]):
            a += 1
        while z > a and not masks[heard[z]]:
            z -= 1
    return a, z, s


def cheapest_path(costs: list[list[float]], join: Callable[[int, int, int], float]) -> list[int]:
    """One option per step with the least sum of own costs and join costs (Viterbi); the first of equals."""
    if not costs:
        return []
    total, back = list(costs[0]), []
    for k in range(1, len(costs)):
        row, way = [], []
        for j, c in enumerate(costs[k]):
            best, at = None, 0
            for i, t in enumerate(total):
                v = t + join(k, i, j)
                if best is None or v < best:
                    best, at = v, i
            row.append(best + c)
            way.append(at)
        total = row
        back.append(way)
    j = min(range(len(total)), key=lambda x: (total[x], x))
    path = [j]
    for way in reversed(back):
        j = way[j]
        path.append(j)
    return path[::-1]


def align_takes(takes: list[list[list[str]]], least: float = 0.6, ahead: int = 4, merged: int = 3) -> list[list[tuple[int, int] | None]]:
    """For each line of the spine (the take with most words) the lines (first, last) of every take that say it, or None.

    Per take a cursor moves forward only: up to ``ahead`` lines are looked ahead and up to ``merged`` joined; the first best of similarity
    ``least`` or more counts.
    """
    if not takes:
        return []
    spine = max(range(len(takes)), key=lambda t: (sum(map(len, takes[t])), -t))
    cursor = [0] * len(takes)
    out: list[list[tuple[int, int] | None]] = []
    for k, line in enumerate(takes[spine]):
        row: list[tuple[int, int] | None] = []
        for t, lines in enumerate(takes):
            if t == spine:
                row.append((k, k))
                continue
            best: tuple[float, int, int] | None = None
            for s in range(cursor[t], min(cursor[t] + ahead, len(lines))):
                words: list[str] = []
                for e in range(s, min(s + merged, len(lines))):
                    words = words + lines[e]
                    v = similarity(line, words)
                    if v >= least and (best is None or v > best[0]):
                        best = (v, s, e)
            if best is None:
                row.append(None)
            else:
                row.append((best[1], best[2]))
                cursor[t] = best[2] + 1
        out.append(row)
    return out


def rendition_score(n_words: int, fillers: int, restarts: int, stalls: int, confidence: float, separation: float | None, framing: float | None = None, penalty: float = 0.25) -> dict[str, float]:
    """Fluency, clarity, audio (0.5 where it isn't known) and framing, and their mean over the axes there are."""
    axes = {"fluency": max(0.0, 1 - penalty * (fillers + restarts + stalls)), "clarity": confidence, "audio": 0.5 if separation is None else min(max((separation - 10) / 25, 0.0), 1.0)}
    if framing is not None:
        axes["framing"] = framing
    return {**axes, "score": sum(axes.values()) / len(axes)}


def deciding_axis(winner: dict[str, float], runner_up: dict[str, float]) -> str:
    gaps = {a: winner[a] - runner_up[a] for a in winner if a != "score" and a in runner_up}
    axis = max(gaps, key=lambda a: (gaps[a], a))
    return "near tie" if gaps[axis] <= 0.001 else axis


def best_mapping(shared: dict[tuple, int], refs: list, hyps: list) -> dict:
    """One-to-one mapping of hypothesis to reference speakers with the most shared time (augmenting paths on potentials)."""
    n = max(len(refs), len(hyps))
    cost = [[-(shared.get((refs[i], hyps[j]), 0) if i < len(refs) and j < len(hyps) else 0) for j in range(n)] for i in range(n)]
    u, v, p, way = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
    return {hyps[j - 1]: refs[p[j] - 1] for j in range(1, n + 1) if j <= len(hyps) and p[j] <= len(refs)}


def diarization_error(reference: list[tuple], hypothesis: list[tuple]) -> dict[str, int]:
    """Missed, false and confused speaker time of (speaker, start, end) lists under the best mapping; overlaps count per speaker."""
    edges = sorted({t for _, s, e in [*reference, *hypothesis] for t in (s, e)})
    at = {t: i for i, t in enumerate(edges)}
    ref: list[set] = [set() for _ in edges]
    hyp: list[set] = [set() for _ in edges]
    for sets, rows in ((ref, reference), (hyp, hypothesis)):
        for k, s, e in rows:
            for i in range(at[s], at[e]):
                sets[i].add(k)
    shared: Counter = Counter()
    for i in range(len(edges) - 1):
        d = edges[i + 1] - edges[i]
        for r in ref[i]:
            for h in hyp[i]:
                shared[r, h] += d
    mapping = best_mapping(shared, sorted({k for k, *_ in reference}, key=str), sorted({k for k, *_ in hypothesis}, key=str))
    out = {"speech": 0, "missed": 0, "false": 0, "confused": 0}
    for i in range(len(edges) - 1):
        d, nr, nh = edges[i + 1] - edges[i], len(ref[i]), len(hyp[i])
        right = sum(mapping.get(h) in ref[i] for h in hyp[i] if h in mapping)
        out["speech"] += d * nr
        out["missed"] += d * max(0, nr - nh)
        out["false"] += d * max(0, nh - nr)
        out["confused"] += d * (min(nr, nh) - right)
    return out


# ---- operators -------------------------------------------------------------------------------------------------------


def _ordered(words: DataFrame, key: str) -> DataFrame:
    return words.select(F.col(key).alias("key"), "idx", "word", "start_ms", "end_ms")


def per_group(rows: DataFrame, keys: Sequence[str], order: str, kernel: Callable[[list[dict]], list[tuple]], columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """A kernel over the rows of each group in order, as dictionaries; many small groups share an Arrow batch and a Python call.

    Returns the keys and ``columns``.
    """
    rest = [c for c in rows.columns if c not in keys and c != order]
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("rows"))
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], *[T.StructField(n, t) for n, t in columns]])
    arrow = to_arrow_schema(schema)
    n = len(keys)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                at, out = [], [[] for _ in columns]
                for k, own in enumerate(part.column(n).to_pylist()):
                    for r in kernel(own):
                        at.append(k)
                        for c, v in zip(out, r):
                            c.append(v)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(j).take(take) for j in range(n)], *[pa.array(c, f.type) for c, f in zip(out, list(arrow)[n:])]], schema=arrow)

    return g.mapInArrow(run, schema)


_INT, _LONG, _REAL, _TEXT, _FLAG = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def find_self_corrections(words: DataFrame, key: str, chunk: int = 2_000) -> DataFrame:
    """Abandoned runs and those said instead: key, abandoned_first, abandoned_last, kept_first, kept_last, similarity. ``idx`` counts a recording's words from 0.

    The best pair at a place depends on the 24 words from there on, so it is looked for in chunks that reach so far into the next; the choice from the
    left then runs over the few places that have one."""
    reach = 2 * LONGEST
    w = _ordered(words, key).withColumn("chunk", F.explode(F.array_distinct(F.array(F.expr(f"idx div {chunk}"), F.expr(f"greatest(idx - {reach - 1}, 0) div {chunk}")))))

    def kernel(rows: list[dict]) -> list[tuple]:
        first = rows[0]["idx"]
        own = (first // chunk + 1) * chunk - first
        found = best_corrections([r["word"] for r in rows], [r["start_ms"] for r in rows], [r["end_ms"] for r in rows], own)
        return [(first + i, n, m, s) for i, n, m, s in found]

    hits = per_group(w, ["key", "chunk"], "idx", kernel, [("at", _INT), ("n", _INT), ("m", _INT), ("s", _REAL)]).drop("chunk")
    choose = lambda rows: greedy_corrections([(r["at"], r["n"], r["m"], r["s"]) for r in rows])
    columns = [("abandoned_first", _INT), ("abandoned_last", _INT), ("kept_first", _INT), ("kept_last", _INT), ("similarity", _REAL)]
    return per_group(hits, ["key"], "at", choose, columns).withColumnRenamed("key", key)


def caption(words: DataFrame, key: str, size: int = 4, breath_ms: int = 350, block: int = 50_000) -> DataFrame:
    """Captions of a recording: key, caption (from 0), text, start_ms, end_ms; as ``caption_groups`` divides them.

    A final mark or a pause ends a caption for certain, so the words between two of those are divided on their own; places and numbers come from
    prefix operations in blocks of words."""
    from tapewright.operators.blocked import blocks, carry_forward, previous, running_sum

    w = blocks(_ordered(words, key).withColumn("said", F.struct("word", "end_ms")), "idx", block)
    w = previous(w, ["key"], "__block", ["idx"], "said", "was")
    was = F.col("was.value")
    w = w.withColumn("fresh", F.coalesce(was["word"].rlike(r"[.?!]$") | (F.col("start_ms") - was["end_ms"] >= breath_ms), F.lit(True)))
    w = w.select("key", "__block", "idx", "word", "start_ms", "end_ms", F.when(F.col("fresh"), F.col("idx")).alias("head"))
    w = carry_forward(w, ["key"], "__block", ["idx"], "head", "first")
    w = w.withColumn("opens", ((F.col("idx") - F.col("first")) % size == 0).cast("int")).drop("head", "first")
    w = running_sum(w, ["key"], "__block", ["idx"], "opens", "caption")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    g = w.groupBy("key", "caption").agg(text.alias("text"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"))
    return g.select(F.col("key").alias(key), (F.col("caption") - 1).cast("int").alias("caption"), "text", "start_ms", "end_ms")


def repeated_lines(lines: DataFrame, key: str, order: str, text: str, start: str, least: float = 0.72) -> DataFrame:
    """Lines said more than once in a recording: group, attempts, spread in time, passes, and whether the repeats are spread out.

    Spread out: over more than 90 s, or where there are several passes, more attempts than passes.
    """
    l = lines.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text"), F.col(start).cast("bigint").alias("at"))

    def kernel(rows: list[dict]) -> list[tuple]:
        said = [(r, t) for r, t in ((r, key_words(r["text"])) for r in rows) if t]
        g = leader_groups([t for _, t in said], least)
        passes = count_passes(g, len(set(g)))
        by: dict[int, list[dict]] = defaultdict(list)
        for n, (r, _) in zip(g, said):
            by[n].append(r)
        out = []
        for n, own in sorted(by.items()):
            if len(own) > 1:
                spread = max(r["at"] for r in own) - min(r["at"] for r in own)
                out.append((n, len(own), own[0]["text"], spread, passes, len(own) > passes if passes > 1 else spread > 90_000))
        return out

    columns = [("line_group", _INT), ("attempts", _INT), ("text", _TEXT), ("spread_ms", _LONG), ("passes", _INT), ("spread_out", _FLAG)]
    return per_group(l, ["key"], "ord", kernel, columns).withColumnRenamed("key", key)


def vote(primary: DataFrame, secondary: DataFrame, key: str, window_ms: int = 30_000, slack_ms: int = 2_000, agreeing: float = 0.95, disagreeing: float = 0.55) -> DataFrame:
    """Words of the primary engine with their confidence after a vote by sequence: matched words in a window are agreed on.

    The secondary's words take part in every window they are within ``slack_ms`` of, so windows are independent tasks. Each group is
    the words of one window.
    """
    from tapewright.functions.exact_time import floor_div

    w = F.lit(window_ms)
    cols = ["key", "win", "idx", "word"]
    a = _ordered(primary, key).withColumn("win", floor_div(F.col("start_ms"), w)).select(*cols).withColumn("mine", F.lit(True))
    b = _ordered(secondary, key).withColumn("win", F.explode(F.sequence(floor_div(F.col("start_ms") - slack_ms, w), floor_div(F.col("start_ms") + slack_ms, w)))).select(*cols).withColumn("mine", F.lit(False))

    def kernel(rows: list[dict]) -> list[tuple]:
        mine, theirs = [r for r in rows if r["mine"]], [r for r in rows if not r["mine"]]
        hit = set(matched_indices([trimmed(r["word"]) for r in mine], [trimmed(r["word"]) for r in theirs]))
        return [(r["idx"], r["word"], agreeing if i in hit else disagreeing, 1 + (i in hit)) for i, r in enumerate(mine)]

    columns = [("idx", a.schema["idx"].dataType), ("word", _TEXT), ("confidence", _REAL), ("n_sources", _INT)]
    return per_group(a.unionByName(b), ["key", "win"], "idx", kernel, columns).drop("win").withColumnRenamed("key", key)


@F.pandas_udf(T.DoubleType())
def similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS similarity of two arrays of words."""
    return pd.Series([None if x is None or y is None else similarity(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def word_errors_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word edit distance of two arrays of words; a missing hypothesis is a total loss."""
    return pd.Series([0 if x is None else len(x) if y is None else word_errors(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def word_error_rate(pairs: DataFrame, keys: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """Sum of errors over sum of reference words."""
    e = pairs.select(*keys, F.size(reference).alias("n"), word_errors_of(reference, hypothesis).alias("errors"))
    g = e.groupBy(*keys) if keys else e.groupBy()
    return g.agg(F.sum("errors").alias("errors"), F.sum("n").alias("n_words")).withColumn("wer", F.try_divide(F.col("errors"), F.col("n_words")))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("h", T.StringType()), T.StructField("r", T.StringType())])))
def _mapped(shared: pd.Series) -> pd.Series:
    out = []
    for own in shared:
        cells = {(x["r"], x["h"]): x["us"] for x in own}
        refs, hyps = sorted({r for r, _ in cells}), sorted({h for _, h in cells})
        out.append([{"h": h, "r": r} for h, r in best_mapping(cells, refs, hyps).items()])
    return pd.Series(out)


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, key: str, width: int = 10 * 10**6, block: int = 3600 * 10**6) -> DataFrame:
    """Per recording of the reference: speech, missed, false and confused time and their share. Rows: key, speaker, start, end (integers). Turns without a speaker
    and empty ones are left out.

    The time that speakers share is summed over overlapping turns, the mapping with the most shared time is found over a recording's speakers alone, and
    one sweep over the edges of both sides and of the shared turns of mapped speakers, in blocks of time, sums up the errors (as ``diarization_error`` does).
    """
    from tapewright.operators.blocked import blocks, following, running_sums
    from tapewright.operators.intervals import merge, overlap_pairs
    from tapewright.session import cut_lineage

    def side(df: DataFrame, who: str) -> DataFrame:
        d = df.select(F.col(key).alias("key"), F.col("speaker").cast("string").alias(who), F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"))
        return cut_lineage(merge(d.where(f"key IS NOT NULL AND {who} IS NOT NULL AND e > s"), ["key", who], "s", "e"))

    r, h = side(reference, "r"), side(hypothesis, "h").withColumnsRenamed({"s": "hs", "e": "he"})
    both = cut_lineage(overlap_pairs(r, h, ["key"], ("s", "e"), ("hs", "he"), width).select("key", "r", "h", F.greatest("s", "hs").alias("s"), F.least("e", "he").alias("e")))
    shared = both.groupBy("key", "r", "h").agg(F.sum(F.col("e") - F.col("s")).alias("us"))
    pairs = shared.groupBy("key").agg(F.collect_list(F.struct("r", "h", "us")).alias("cells")).select(F.col("key").alias("m_key"), F.inline(_mapped("cells"))).withColumnsRenamed({"h": "m_h", "r": "m_r"})
    right = both.join(pairs, (F.col("key") == F.col("m_key")) & (F.col("r") == F.col("m_r")) & (F.col("h") == F.col("m_h"))).select("key", "s", "e")
    names = ("nr", "nh", "nc")
    edges = None
    for n, df in zip(names, (r.select("key", "s", "e"), h.select("key", F.col("hs").alias("s"), F.col("he").alias("e")), right)):
        for at, sign in (("s", 1), ("e", -1)):
            d = df.select("key", F.col(at).alias("at"), *[F.lit(sign if c == n else 0).alias(c) for c in names])
            edges = d if edges is None else edges.unionByName(d)
    e = blocks(edges.groupBy("key", "at").agg(*[F.sum(c).alias(c) for c in names]), "at", block)
    e = running_sums(e, ["key"], "__block", ["at"], {c: f"{c}_now" for c in names})
    e = following(e, ["key"], "__block", ["at"], "at", "next").where("next IS NOT NULL").withColumn("d", F.col("next.value") - F.col("at"))
    nr, nh, nc = (F.col(f"{c}_now") for c in names)
    sums = e.groupBy("key").agg(
        F.sum(F.col("d") * nr).alias("speech"), F.sum(F.col("d") * F.greatest(nr - nh, F.lit(0))).alias("missed"), F.sum(F.col("d") * F.greatest(nh - nr, F.lit(0))).alias("false_alarm"), F.sum(F.col("d") * (F.least(nr, nh) - nc)).alias("confused")
    )
    counts = r.groupBy("key").agg(F.count_distinct("r").alias("n_r")).join(h.groupBy("key").agg(F.count_distinct("h").alias("n_h")), "key", "left")
    j = sums.join(counts, "key")
    total = F.col("missed") + F.col("false_alarm") + F.col("confused")
    return j.select(F.col("key").alias(key), "speech", "missed", "false_alarm", "confused", F.try_divide(total.cast("double"), F.col("speech")).alias("der"), (F.col("n_r") - F.coalesce("n_h", F.lit(0))).cast("int").alias("count_error"))

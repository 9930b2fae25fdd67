"""Queries on words, phrases, scripts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import normalise as N
from tapewright.operators import wording as W
from tapewright.plans.catalog import Catalog
from tapewright.sources.standins import WORDS, words
from tapewright.sources.tables import table

CATALOG = Catalog()

_TRIMMED = r"regexp_replace(regexp_replace(lower(word), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')"
_BARE = r"regexp_replace(lower(word), '[^\p{L}\p{N}]', '', 'g')"
_SPOKEN = r"regexp_replace(lower(word), '[^\p{L}\p{N}'']', '', 'g')"
_ASR = """r AS (SELECT DISTINCT utterance_id, apple, parakeet FROM asr_real_transcripts WHERE apple IS NOT NULL AND parakeet IS NOT NULL)"""


@CATALOG.add(
    "text_fillers",
    r"""WITH w AS (SELECT line_id, unnest(regexp_extract_all(raw_line, '(\S+)', 1)) AS word FROM (SELECT DISTINCT line_id, raw_line FROM raw_transcripts))
    SELECT line_id, count(*) AS n_words, count(*) FILTER (WHERE """
    + _TRIMMED
    + """ IN ('um','uh','erm','hmm','mm','eh','ah')) AS n_fillers FROM w GROUP BY line_id""",
)
def text_fillers(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "raw_transcripts").select("line_id", "raw_line").distinct().select("line_id", F.explode(F.regexp_extract_all("raw_line", F.lit(r"(\S+)"), F.lit(1))).alias("word"))
    return w.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(N.is_filler(F.col("word"))).alias("n_fillers"))


_LOCATE = f"""WITH {WORDS}, n AS (SELECT doc_id, idx, {_SPOKEN} AS s FROM w), k AS (SELECT * FROM n WHERE s <> ''),
l AS (SELECT doc_id, idx, s, lead(s, 1) OVER v AS s1, lead(s, 2) OVER v AS s2 FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx FROM l WHERE s = 'on' AND s1 = 'the' AND s2 = 'second'"""


@CATALOG.add("text_locate", _LOCATE)
def text_locate(spark: SparkSession, sf: str) -> DataFrame:
    return W.locate(words(spark, sf), "doc_id", ["on", "the", "second"])


_SEGMENTS = f"""WITH {WORDS}, m AS (SELECT *, CASE WHEN regexp_matches(word, '[.?!]$') OR coalesce(lead(start_ms) OVER v - end_ms > 600, false) THEN 1 ELSE 0 END AS ends FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM m)
SELECT doc_id, min(idx) AS first_idx, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY doc_id, n"""


@CATALOG.add("text_segments", _SEGMENTS)
def text_segments(spark: SparkSession, sf: str) -> DataFrame:
    return W.segments(words(spark, sf), "doc_id")


@CATALOG.add("text_low_confidence", f"WITH {WORDS} SELECT doc_id, idx, word, conf FROM w WHERE conf < 55")
def text_low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).where("conf < 55").select("doc_id", "idx", "word", "conf")


_STEM = "CASE WHEN {x} LIKE '%ing' AND length({x}) >= 6 THEN left({x}, length({x}) - 3) WHEN {x} LIKE '%ed' AND length({x}) >= 5 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%es' AND length({x}) >= 5 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%s' AND length({x}) >= 4 THEN left({x}, length({x}) - 1) ELSE {x} END"
_SAME = f"""WITH {_ASR}, p AS (SELECT utterance_id, i, lower(regexp_replace(a[i], '[^A-Za-z]', '', 'g')) AS a, lower(regexp_replace(b[i], '[^A-Za-z]', '', 'g')) AS b
  FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM (SELECT utterance_id, regexp_extract_all(apple, '(\\S+)', 1) AS a, regexp_extract_all(parakeet, '(\\S+)', 1) AS b FROM r)))
SELECT utterance_id, i::INT AS i, levenshtein(a, b)::INT AS distance, a = b OR {_STEM.format(x='a')} = {_STEM.format(x='b')}
  OR (length(a) >= 4 AND length(b) >= 4 AND abs(length(a) - length(b)) <= greatest(1, greatest(length(a), length(b)) // 4) AND levenshtein(a, b) <= greatest(1, greatest(length(a), length(b)) // 4)) AS same FROM p"""


@CATALOG.add("text_same_word", _SAME)
def text_same_word(spark: SparkSession, sf: str) -> DataFrame:
    """Words at the same place of two readings: their edit distance and whether they are the same word by sound."""
    r = table(spark, sf, "asr_real_transcripts").where("apple IS NOT NULL AND parakeet IS NOT NULL").select("utterance_id", "apple", "parakeet").distinct()
    split = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))
    z = r.select("utterance_id", F.posexplode(F.arrays_zip(split("apple").alias("a"), split("parakeet").alias("b"))).alias("i", "p")).where("p.a IS NOT NULL AND p.b IS NOT NULL")
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    z = z.select("utterance_id", (F.col("i") + 1).alias("i"), plain("p.a").alias("a"), plain("p.b").alias("b"))
    return z.select("utterance_id", "i", F.levenshtein("a", "b").alias("distance"), N.same_word(F.col("a"), F.col("b")).alias("same"))


_STOP = ", ".join(f"'{x}'" for x in N.STOP_WORDS)
_COHESION = f"""WITH {WORDS}, t AS (SELECT doc_id, idx // 40 AS block, {_BARE} AS term FROM w),
v AS (SELECT doc_id, block, term, count(*) AS n FROM t WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
m AS (SELECT doc_id, block, sqrt(sum(n * n)) AS norm FROM v GROUP BY ALL),
d AS (SELECT a.doc_id, a.block, sum(a.n * b.n) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.block = a.block + 1 AND a.term = b.term GROUP BY ALL)
SELECT a.doc_id, a.block::BIGINT AS block, round(coalesce(dot / (a.norm * b.norm), 0.0), 6) AS cohesion FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.block = a.block + 1 LEFT JOIN d ON d.doc_id = a.doc_id AND d.block = a.block"""


@CATALOG.add("text_cohesion", _COHESION)
def text_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return W.neighbour_cohesion(words(spark, sf), "doc_id", 40).withColumn("cohesion", F.round("cohesion", 6))


_SOURCES = f"""WITH {WORDS}, t AS (SELECT lower(trim(d.source)) AS source, {_BARE} AS term FROM w JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL),
v AS (SELECT source, term, count(*) AS n FROM t WHERE length(term) > 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
a AS (SELECT term, sum(n) AS all_n FROM v GROUP BY term),
s AS (SELECT source, term, n, (all_n - n)::BIGINT AS elsewhere, n / (all_n - n + n / 8.0::DOUBLE) AS score FROM v JOIN a USING (term) WHERE n >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s)"""


@CATALOG.add("text_distinctive", _SOURCES + ' SELECT source, term, n AS here, elsewhere, round(score, 6) AS score, rank::INT AS "rank" FROM k WHERE rank <= 6')
def text_distinctive(spark: SparkSession, sf: str) -> DataFrame:
    return _source_terms(spark, sf).withColumn("score", F.round("score", 6))


def _source_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return W.distinctive_terms(W.term_vectors(words(spark, sf).join(d, "doc_id"), ["source"]), "source")


@CATALOG.add("text_section_labels", _SOURCES + ", l AS (SELECT source, string_agg(upper(term), ' ' ORDER BY rank) AS label FROM k WHERE rank <= 2 GROUP BY source), g AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE source IS NOT NULL) SELECT g.source, coalesce(label, 'SECTION') AS label FROM g LEFT JOIN l ON g.source = l.source")
def text_section_labels(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "documents").where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("source"))
    return W.section_labels(_source_terms(spark, sf), "source", groups)


_SCRIPT = r"""WITH p AS (SELECT line_id, unnest(l) AS part, unnest(range(len(l)))::INT AS ord FROM (SELECT DISTINCT line_id, regexp_extract_all(raw_line, '\[([^\]]*)\]([^\[]*)') AS l FROM raw_transcripts)),
q AS (SELECT line_id, ord, trim(regexp_extract(part, '\[([^\]]*)\]', 1)) AS marker, trim(replace(regexp_replace(part, '^\[[^\]]*\]', ''), '*', '')) AS line FROM p)
SELECT line_id, ord, marker, CASE WHEN lower(marker) LIKE '%top%' THEN 'top' WHEN lower(marker) LIKE '%cent%' OR lower(marker) LIKE '%middle%' THEN 'centre' WHEN lower(marker) LIKE '%bottom%' THEN 'bottom' WHEN lower(marker) LIKE '%all%' THEN 'all' END AS panel, line FROM q"""


@CATALOG.add("text_script", _SCRIPT)
def text_script(spark: SparkSession, sf: str) -> DataFrame:
    return W.parse_script(table(spark, sf, "raw_transcripts").select("line_id", "raw_line").distinct(), "line_id", "raw_line")


@CATALOG.add(
    "text_labels",
    r"""SELECT doc_id, upper(trim(regexp_extract(regexp_replace(title, '^\s*(?:\d+[.):]|[A-Za-z][.)])\s*', ''), '^([^.!?\n]*)', 1))) AS label FROM documents WHERE title IS NOT NULL""",
)
def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", W.label_of(F.col("title")).alias("label"))


_PLAN = f"""WITH {WORDS}, m AS (SELECT *, conf < 50 AS gone, lag(end_ms) OVER v AS pe, lead(start_ms) OVER v AS ns FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY idx)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM m WHERE gone),
r AS (SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx, min(start_ms) AS s, max(end_ms) AS e, arg_min(pe, idx) FILTER (WHERE pe IS NOT NULL) AS pe, arg_max(ns, idx) FILTER (WHERE ns IS NOT NULL) AS ns, min(idx) = 0 AS head FROM g GROUP BY doc_id, run)
SELECT doc_id, first_idx, last_idx, CASE WHEN head THEN s ELSE s - floor(greatest(s - pe, 0) * (1 - 0.35::DOUBLE))::BIGINT END AS start_ms, greatest(e, coalesce(ns, e)) AS end_ms FROM r"""


@CATALOG.add("text_removal_plan", _PLAN)
def text_removal_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The balanced plan that removes the least sure words."""
    return W.removal_plan(words(spark, sf), F.col("conf") < 50, "doc_id", 0.35)


_REQUESTED = f"""WITH {WORDS}, rq AS (SELECT DISTINCT doc_id, idx FROM (SELECT d.doc_id, unnest(c.removed_words) AS idx FROM cut_plans c JOIN documents d ON c.asset = d.asset) WHERE idx IS NOT NULL),
x AS (SELECT w.*, r.idx IS NOT NULL AS gone, lag(end_ms) OVER v AS pe, lead(start_ms) OVER v AS ns FROM w LEFT JOIN rq r ON w.doc_id = r.doc_id AND w.idx = r.idx WINDOW v AS (PARTITION BY w.doc_id ORDER BY w.idx)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM x WHERE gone),
r AS (SELECT doc_id, min(idx) AS first_idx, min(start_ms) AS s, max(end_ms) AS e, arg_min(pe, idx) FILTER (WHERE pe IS NOT NULL) AS pe, arg_max(ns, idx) FILTER (WHERE ns IS NOT NULL) AS ns, min(idx) = 0 AS head FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, CASE WHEN head THEN s ELSE s - floor(greatest(s - pe, 0) * (1 - 0.35::DOUBLE))::BIGINT END AS start_ms, greatest(e, coalesce(ns, e)) AS end_ms FROM r),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, max(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE end_ms > start_ms))
SELECT doc_id, 'cut' AS kind, min(start_ms) AS start_ms, max(end_ms) AS end_ms, NULL::INT AS idx FROM k GROUP BY doc_id, n
UNION ALL SELECT rq.doc_id, 'unknown', NULL, NULL, rq.idx FROM rq LEFT JOIN w ON rq.doc_id = w.doc_id AND rq.idx = w.idx WHERE w.idx IS NULL"""


@CATALOG.add("text_requested_removals", _REQUESTED)
def text_requested_removals(spark: SparkSession, sf: str) -> DataFrame:
    """The words that the cut plans of a recording remove, taken out of its documents: the cuts, and the words that aren't there."""
    d = table(spark, sf, "documents").where("asset IS NOT NULL").select("doc_id", F.col("asset").alias("d_asset"))
    # what is asked for stays one list of each recording until it is with a document
    r = table(spark, sf, "cut_plans").where("asset IS NOT NULL").select("asset", F.explode("removed_words").alias("idx")).groupBy("asset").agg(F.collect_set("idx").alias("asked"))
    r = d.join(r.hint("merge"), F.col("d_asset") == F.col("asset")).select("doc_id", F.explode("asked").alias("idx"))
    plan, unknown = W.requested_removals(words(spark, sf), r, "doc_id", 0.35)
    cuts = plan.select("doc_id", F.lit("cut").alias("kind"), "start_ms", "end_ms", F.lit(None).cast("int").alias("idx"))
    return cuts.unionByName(unknown.select("doc_id", F.lit("unknown").alias("kind"), F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"), "idx"))


_ANSWERS = """a AS (SELECT user_id, count(*) AS n, string_agg(CASE WHEN event_id % 7 = 0 THEN 'no idea' ELSE (event_id % 60)::VARCHAR || '-' || (event_id % 60 + event_id % 9 - 2)::VARCHAR || ' | ' || event_type END, chr(10) ORDER BY event_id) AS answer FROM events GROUP BY user_id)"""
_SPANS = (
    r"WITH RECURSIVE "
    + _ANSWERS
    + r""", l AS (SELECT user_id, n, unnest(s) AS line, unnest(range(len(s)))::INT AS line_no FROM (SELECT user_id, n, string_split(answer, chr(10)) AS s FROM a)),
p AS (SELECT *, TRY_CAST(regexp_extract(line, '^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*\|\s*(.*?)\s*$', 1) AS INT) AS first, TRY_CAST(regexp_extract(line, '^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*\|\s*(.*?)\s*$', 2) AS INT) AS last,
  regexp_extract(line, '^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*\|\s*(.*?)\s*$', 3) AS reason FROM l WHERE trim(line) <> ''),
q AS (SELECT *, CASE WHEN first IS NULL OR last IS NULL THEN 'malformed' WHEN last < first THEN 'reversed' WHEN last >= n THEN 'unknown word' WHEN (last - first + 1) * 5 >= n * 2 THEN 'too long' END AS why FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line_no) AS k FROM q WHERE why IS NULL),
f AS (SELECT user_id, k, line_no, [[first, last]] AS kept, true AS ok FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.line_no, CASE WHEN len(list_filter(f.kept, lambda x: x[1] <= o.last AND o.first <= x[2])) > 0 THEN f.kept ELSE list_append(f.kept, [o.first, o.last]) END,
    len(list_filter(f.kept, lambda x: x[1] <= o.last AND o.first <= x[2])) = 0 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT q.user_id, q.line_no, q.first, q.last, q.reason, coalesce(q.why, CASE WHEN NOT f.ok THEN 'overlap' END) AS why FROM q LEFT JOIN f ON f.user_id = q.user_id AND f.line_no = q.line_no"""
)


@CATALOG.add("text_answer_spans", _SPANS)
def text_answer_spans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    line = F.when(i % 7 == 0, "no idea").otherwise(F.concat((i % 60).cast("string"), F.lit("-"), (i % 60 + i % 9 - 2).cast("string"), F.lit(" | "), "event_type"))
    a = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    return W.parse_spans(a, "user_id", "answer", "n")


_VERDICT = r"""WITH x AS (SELECT event_id, ['A. The first', 'answer: B', 'either A or B', 'Both', 'b) second', 'ABLE'][event_id % 6 + 1] AS one, ['B', 'A', 'a', 'option A', 'B!', ''][event_id % 6 + 1] AS two, value FROM events),
v AS (SELECT *, CASE WHEN regexp_matches(upper(one), '(^|[^A-Z0-9])A([^A-Z0-9]|$)') AND NOT regexp_matches(upper(one), '(^|[^A-Z0-9])B([^A-Z0-9]|$)') THEN 'first'
  WHEN regexp_matches(upper(one), '(^|[^A-Z0-9])B([^A-Z0-9]|$)') AND NOT regexp_matches(upper(one), '(^|[^A-Z0-9])A([^A-Z0-9]|$)') THEN 'second' ELSE 'unclear' END AS v1,
  CASE WHEN regexp_matches(upper(two), '(^|[^A-Z0-9])A([^A-Z0-9]|$)') AND NOT regexp_matches(upper(two), '(^|[^A-Z0-9])B([^A-Z0-9]|$)') THEN 'second'
  WHEN regexp_matches(upper(two), '(^|[^A-Z0-9])B([^A-Z0-9]|$)') AND NOT regexp_matches(upper(two), '(^|[^A-Z0-9])A([^A-Z0-9]|$)') THEN 'first' ELSE 'unclear' END AS v2 FROM x)
SELECT event_id, v1, v2, CASE WHEN v1 = v2 THEN v1 ELSE 'unclear' END AS agreed, NOT (value / 50 <= 1.0 AND (event_id % 10) / 10.0::DOUBLE >= 0.65) AS stands FROM v"""


@CATALOG.add("text_verdicts", _VERDICT)
def text_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to a question asked twice with the options swapped."""
    k = (F.col("event_id") % 6 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k)
    x = table(spark, sf, "events").select("event_id", "value", pick("A. The first", "answer: B", "either A or B", "Both", "b) second", "ABLE").alias("one"), pick("B", "A", "a", "option A", "B!", "").alias("two"))
    x = x.withColumn("v1", W.verdict(F.col("one"))).withColumn("v2", W.verdict(F.col("two"), reverse=True))
    return x.select("event_id", "v1", "v2", W.agreed(F.col("v1"), F.col("v2")).alias("agreed"), W.veto_stands(F.col("value") / 50, F.col("event_id") % 10 / 10.0).alias("stands"))


_JSON = r"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Sure: ' || props || ' done' WHEN 1 THEN replace(props, '}', ',}') WHEN 2 THEN 'none; of it' ELSE props END AS t FROM events),
b AS (SELECT event_id, regexp_extract(t, '(?s)(\{.*\})', 1) AS body, t FROM x), f AS (SELECT *, regexp_replace(body, ',\s*([}\]])', '\1', 'g') AS fixed FROM b)
SELECT event_id, CASE WHEN body <> '' AND json_valid(body) AND NOT regexp_matches(body, ',\s*[}\]]') THEN body WHEN fixed <> '' AND json_valid(fixed) THEN fixed END AS object, left(trim(regexp_extract(t, '^([^.;\n]*)', 1)), 80) AS phrase FROM f"""


@CATALOG.add("text_lenient_json", _JSON)
def text_lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k, p = F.col("event_id") % 4, F.col("props")
    t = F.when(k == 0, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(k == 1, F.replace(p, F.lit("}"), F.lit(",}"))).when(k == 2, "none; of it").otherwise(p)
    return e.select("event_id", W.lenient_object(t).alias("object"), W.short_phrase(t).alias("phrase"))


_WINDOWS = f"""WITH {WORDS}, n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), s AS (SELECT doc_id, n, unnest(generate_series(0, greatest(n - 41, 0), 140)) AS first FROM n)
SELECT doc_id, (first // 140)::INT AS window_no, first, least(first + 180, n) - 1 AS last FROM s"""


@CATALOG.add("text_model_windows", _WINDOWS)
def text_model_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 180 words that overlap by 40."""
    n = words(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return W.context_windows(n, "doc_id", "n", 180, 40)


_CONTEXT = f"""WITH {WORDS}, e AS (SELECT doc_id, idx, CASE WHEN regexp_matches(word, '[.?!]$') THEN idx END AS stop FROM w), t AS (SELECT doc_id, max(idx) AS top FROM e GROUP BY doc_id),
p AS (SELECT doc_id, idx, lag(upto) OVER (PARTITION BY doc_id ORDER BY idx) AS pe FROM (SELECT doc_id, idx, last_value(stop IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM e)),
n AS (SELECT doc_id, idx, lag(upto) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS ne FROM (SELECT doc_id, idx, last_value(stop IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx DESC) AS upto FROM e))
SELECT p.doc_id, p.idx AS first, n.idx AS last, greatest(coalesce(pe + 1, 0), p.idx - 20) AS "from", least(coalesce(ne, top), n.idx + 20) AS "to" FROM p JOIN n ON p.doc_id = n.doc_id AND n.idx = p.idx + 2 JOIN t ON p.doc_id = t.doc_id"""


@CATALOG.add("text_sentence_context", _CONTEXT)
def text_sentence_context(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences around every three words."""
    return W.sentence_context_of_each(words(spark, sf, whole=True), "doc_id", 3, 20)

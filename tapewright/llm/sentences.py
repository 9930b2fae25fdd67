"""Sentences of texts in any language and script.

A text is cut at blank lines, list items and speaker labels; each piece is then divided by semi-Markov dynamic programming. The
candidates are the places after final marks (and the closing quotes behind them) and, in scripts that do
without marks, the spaces. The program chooses whole spans: a span scores by how its first words open, how its
last words close, its length, and whether quotes and brackets balance in it, and the division with the largest sum wins. So
a mark inside a quotation costs two unbalanced spans, while a quote that is never closed costs only one. A place that hardly ends a
sentence (behind an abbreviation, before a small letter) has a score far below that of others and is weighed like them.
The length has a log-normal prior, bounded so that it decides between weak places (a space between two short phrases) and never undoes
a certain one.

The prior is the same for all spans longer than ``FAR``. So of the starts farther back than that only the best of each state of open
quotes matters, and the best of all; the others are tried one by one. The best division is found exactly, in time that grows
with the text, however long a piece without a certain end is.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: word lists. -------------------------------------------------------------------------------------
#: Before a name; never the end of a sentence.
TITLES = set(
    "mr mrs ms dr prof rev hon st sr sra srta dra dña d lic ing m mm mme mlle me mgr hr fr frau herr dipl κ κα κος κυ δρ г-н г-жа гр тов акад проф д डॉ प्रो श्री सुश्री د أ م gen col capt lt sgt gov sen rep pres".split()
)
#: Before a number; the end of a sentence only where no number follows.
BEFORE_NUMBER = set("fig figs no nos nr n p pp pg pag pág págs vol vols ch chap sec eq abb bd kap art arts núm num ca approx aprox env circa ок рис стр с гл табл вып см ст σελ εικ αρ περ आकृति पृ ص رقم abs tab zif".split())
#: Never the end of a sentence.
INNER = set("e.g i.e eg ie vs viz cf al z.b d.h u.a i.d.r o.ä s.o v.a p.ej p.e c.-à-d т.е т.к напр ср см π.χ δηλ βλ approx aprox ca env circa ок ungefähr bzw sog inkl zzgl ггг".split())
#: May end a sentence: so if a capital or an opening word follows.
ENDING = set("etc usw usf ect a.m p.m am pm u.s e.u u.k u.n d.c inc ltd co corp jr bros т.д т.п др г гг с сек мин κ.λπ κ.ά κλπ min sec std uhr sek mio mrd uds".split())
#: In front of an ordinal number with a full stop.
BEFORE_ORDINAL = set("am im vom zum beim der die das dem den des ein eine einen einem einer ab bis seit jeder jedes jeden jede zur ins ans diese dieser dieses diesem diesen dritten ersten und oder".split())
#: Verbs after which a name may stand behind a quotation.
SPEECH = set("said asked shouted wrote replied answered whispered called cried added muttered says asks fragte sagte rief dit demanda cria preguntó dijo gritó сказал спросил крикнул είπε ρώτησε φώναξε".split())
#: English function words that open a sentence, for texts without capitals; to these come the words that open elsewhere in the text.
OPENERS = set(
    "the a an this that these those my our your his her its their i you he she it we they one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "who what when where why how which nobody somebody everybody no some any every each all both another if after before during since until under behind between on in at near for from with without by to as there here then "
    "is are was were do does did can could will would should may might must has have had let yes".split()
)
#: Words that carry a sentence on after a mark, for texts without capitals.
CARRIERS = set("and or but nor so then is was are were be said asked shouted says wrote not because while".split())
THAI_JOINERS = ("แต่", "และ", "หรือ", "เพราะ", "ซึ่ง", "โดย", "เพื่อ", "จึง", "ว่า", "ทั้งที่", "แม้", "ถึงแม้", "จน", "กับ", "รวมทั้ง", "ส่วน", "เนื่องจาก", "ดังนั้น")
THAI_FRAMES = ("หลังจาก", "ก่อน", "ใน", "ตั้งแต่", "เมื่อ", "ระหว่าง", "สำหรับ", "ภายใน", "หลัง", "ตอน", "ที่")
THAI_ENDS = ("ครับ", "ค่ะ", "คะ", "ไหม", "แล้ว", "จบ", "นะ", "จ้ะ", "เลย", "ด้วย")
QUOTE_CARRIERS = ("と", "って", "という", "との", "などと", "就", "的", "这", "那样", "之类", "و", "और", "तथा", "लेकिन", "पर", "แล้ว", "และ", "แต่", "ثم", "लिखा", "कहा", "बोला")
SAYING = ("：", ":", "说", "道", "问", "喊", "叫", "答", "說", "問", "قال", "قالت", "कहा", "บอกว่า")
# ---------------------------------------------------------------------------------------------------------------------

_BLANK = regex.compile(r"(?:\r\n|\n|\r| |\u0085)[^\S\n\r]*(?:\r\n|\n|\r| )\s*| \s*|\f\s*")
_LINE = regex.compile(r"[^\n\r ]+")
_BULLET = regex.compile(r"[^\S\n]*(?:[-*•‣▪●◦–—·+]|[①-⑳])[ \t ]+(?=\S)")
_NUMBERED = regex.compile(r"[^\S\n]*(?:\(?(\d{1,3})[.)]|\(?([a-zA-Z])\))[ \t ]+(?=\S)")
_LABEL = regex.compile(r"[^\S\n]*(?:\p{Lu}[\p{Lu}\p{N}_.'-]*+(?: [ _]*+[\p{Lu}\p{N}][\p{Lu}\p{N}_.'-]*+){0,3}+|(?i:speaker|host|guest|narrator|interviewer|producer|caller|moderator|voice)[ _]?\d*)[ \t]?[:：](?=\s)")
#: Final marks: the full stops of all scripts, the ellipsis and the Tibetan shads.
_MARK = r"\p{STerm}…｡‽།༎༏༐༑"
_IS_MARK = regex.compile(rf"[{_MARK}]").match
#: Final marks of scripts that use no other full stop; they need no space behind them.
_NATIVE = regex.compile(r"[\p{STerm}།༎༏༐༑--[.!?…．！？｡。‼⁇⁈⁉․﹒﹖﹗]]", regex.V1).match
_WIDE = "。！？｡．︒︕︖"
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "‹": "›", "„": "“”", "‚": "‘’", "“": "”", "‘": "’", "〝": "〟"}
_CLOSERS = set(")]}）」』】》〉»›”’“‘〟\"'")
#: Closing sign -> what it may close.
_CLOSES = {c: "".join(o for o, cs in _OPEN.items() if c in cs) for c in _CLOSERS}
_THAI = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_SPECIAL = regex.compile(rf"[{_MARK};;]+|[()\[\]{{}}（）「」『』【】《》〈〉«»‹›„‚“”‘’〝〟\"']|(?<=[{_THAI}])\s++|(?<!\s)\s++(?=[{_THAI}])")
_NEXT = regex.compile(r"\s*([\p{Ps}\p{Pi}\p{Pf}\"'¿¡„«*_]*)\s?([\p{L}\p{M}\p{N}]*)")
#: The end of the word before a place; no abbreviation is longer.
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.\-°]{1,64}").match
_NOT_SPACE = regex.compile(r"\S")
_GREEK = regex.compile(r"\p{Greek}").match
_BLANK_LEAD = regex.compile(r"[\s\"'“‘«—-]*+").match
_CAPITAL = regex.compile(r"\p{Lu}")
_SMALL = regex.compile(r"\p{Ll}")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_THAI_CHAR = regex.compile(rf"[{_THAI}]")
_FOREIGN_HEAD = regex.compile(r"\s*[\"“«¿¡(]?\p{Lu}")
_TWO_WORDS = regex.compile(r"(?:\G|(?<![\p{Latin}\p{Cyrillic}\p{Greek}'’,\-]))(?:[\p{Latin}\p{Cyrillic}\p{Greek}'’,\-]++\s++){2}")
_UNCASED_WORDS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Hebrew}\p{Bengali}\p{Tamil}]{2,}+")
_SHORT_SENTENCE = regex.compile(r"[\"“«¿¡(]?\p{Lu}[\p{L}'’]*(?:[ ,]+[\p{L}'’]+){0,2} ?[.!?…]+[\"”»)]?(?:\s|$)")
_FOREIGN_RUN = regex.compile(rf"[^{_THAI}\n]*")
_FRAME_HEAD = regex.compile(rf"[{_THAI}\p{{M}}]{{1,12}}\s*[\p{{N}}.,:]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")

CERTAIN = 4.0
#: The score of a place that hardly ends a sentence.
HARDLY = -8.0
UNBALANCED = -9.0
EMPTY = -6.0
#: The length of a span has a log-normal prior, in letters of an alphabet (median, deviation of the logarithm, least score; twice the least is under CERTAIN - 1).
MEDIAN_LENGTH, LENGTH_DEVIATION, LEAST_LENGTH = 40.0, 1.0, -1.2
#: From this length on the prior is at its least.
FAR = MEDIAN_LENGTH * math.exp(LENGTH_DEVIATION * math.sqrt(-2 * LEAST_LENGTH))
#: A span that opens with a time or place; over twice the least score of a length.
FRAME_OPENS = 2.5
#: What a character counts beyond one in scripts that write a sentence with fewer of them.
CJK_EXTRA, THAI_EXTRA = 2.0, 0.5


class _Place:
    """A candidate end: position, the quotes and brackets open behind it, and its own scores."""

    __slots__ = ("at", "state", "close", "open", "quote", "quote_mid", "quote_start", "space")

    def __init__(self, at: int, state: int):
        self.at, self.state = at, state
        self.close = self.open = 0.0
        self.quote: int | None = None  # where the quotation that closes here was opened
        self.quote_mid = self.quote_start = 0.0  # added if it was opened inside the span, or at its start
        self.space = False


class _Quotes:
    """The quotes and brackets that are open; equal stacks have equal states, the empty one is 0."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # sign, place, the state before it
        self.state = 0
        self._open: Counter[str] = Counter()
        self._ids: dict[tuple[int, str], int] = {}

    def push(self, sign: str, at: int) -> None:
        self.stack.append((sign, at, self.state))
        self._open[sign] += 1
        self.state = self._ids.setdefault((self.state, sign), len(self._ids) + 1)

    def any_of(self, signs: str) -> bool:
        return any(self._open[s] for s in signs)

    def close(self, sign: str) -> int | None:
        """Closes the innermost sign that fits and all opened behind it; where it was opened."""
        at = None
        while self.stack:
            o, at, self.state = self.stack.pop()
            self._open[o] -= 1
            if o == sign or sign in _OPEN.get(o, "") or (sign in "'’" and o in "'‘‚"):
                break
        return at


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _pieces(text: str, a: int, z: int) -> Iterator[tuple[int, int, bool]]:
    """Pieces of a block and whether each is a list item, which is not divided."""
    start, item, number = a, False, 0
    first = True
    for m in _LINE.finditer(text, a, z):
        line = m.group()
        k = text_rstrip(text, start, m.start())
        ended = first or item or k == start or text[k - 1] in ".!?:。！？…\"”»)"
        n = _NUMBERED.match(line)
        value = 0
        if n and n.group(1):
            value = int(n.group(1))
            is_item = ended and (value == number + 1 if item and number else value == 1)
        elif n:
            value = ord(n.group(2).lower()) - 96
            is_item = ended and (value == number + 1 if item and number else value == 1)
        else:
            is_item = ended and _BULLET.match(line) is not None
        label = not is_item and _LABEL.match(line) is not None
        if is_item or label:
            if _NOT_SPACE.search(text, start, m.start()):
                yield start, m.start(), item
            start, item, number = m.start(), is_item, value
        first = False
    yield start, z, item


def _candidates(text: str, a: int, z: int, lower: frozenset | None) -> tuple[list[_Place], int]:
    """The candidates of a piece and the state of quotes and brackets at its end."""
    quotes = _Quotes()
    places: list[_Place] = []
    pending: _Place | None = None
    for m in _SPECIAL.finditer(text, a, z):
        s, at = m.group(), m.start()
        c = s[0]
        if c.isspace():
            if not quotes.state and a < at and m.end() < z:
                p = _Place(at, 0)
                p.space = True
                if _score_space(text, a, z, m.start(), m.end(), p):
                    places.append(p)
            continue
        if c in ";;" or _IS_MARK(c):
            if c in ";;" and not _GREEK(text[at - 1 : at]):
                continue
            pending = _Place(m.end(), quotes.state)
            places.append(pending)
            continue
        # a quote or bracket: does it close what is open?
        prev, nxt = text[at - 1 : at] if at > a else "", text[at + 1 : at + 2] if at + 1 < z else ""
        if c == '"':
            closes = quotes.any_of('"')
        elif c in "'’":
            closes = quotes.any_of("'‘‚") and prev.strip() != "" and not nxt.isalnum()
            if not closes and (c == "’" or not ((prev == "" or prev.isspace() or prev in "([{“\"«") and nxt.strip() != "")):
                continue
        elif c in "“‘":
            closes = bool(quotes.stack) and c in _OPEN.get(quotes.stack[-1][0], "")
        elif c in _OPEN:
            closes = False
        else:
            closes = quotes.any_of(_CLOSES[c])
            if not closes:
                continue
        if closes:
            opened = quotes.close(c)
            if pending is not None and (pending.at == at or (c in "»›" and text_rstrip(text, pending.at, at) == pending.at)):
                pending.at = at + 1
                pending.state = quotes.state
                pending.quote = opened
        else:
            quotes.push(c, at)
    return [p for p in places if p.space or _score_mark(text, a, z, p, lower)], quotes.state


def _foreign_sentence(text: str, a: int, z: int) -> bool:
    """Whether what stands in another script before the next unmarked script is a sentence and not a mere word."""
    run = _FOREIGN_RUN.match(text, a, z).group()
    head = _FOREIGN_HEAD.match(run)
    return bool(
        (head and _TWO_WORDS.search(run, head.end()))
        or _SHORT_SENTENCE.match(run)
        or len(_CJK.findall(run)) >= 5
        or len(_UNCASED_WORDS.findall(run)) >= 2
    )


def _score_space(text: str, a: int, z: int, s: int, e: int, p: _Place) -> bool:
    """A space in a script without marks. False if it can't divide."""
    left, right = text[s - 1], text[e]
    if _IS_MARK(left) or left in _CLOSERS:
        return False
    lt, rt = _THAI_CHAR.match(left) is not None, _THAI_CHAR.match(right) is not None
    if not lt:
        return False
    if not rt:
        if not _foreign_sentence(text, e, z):
            return False
        p.close, p.open = 2.0, 1.5
        return True
    if text.startswith(THAI_JOINERS, e):
        return False
    p.close = 1.5 + (1.5 if any(text.endswith(w, 0, s) for w in THAI_ENDS) else 0.0)
    # a time or place belongs to what follows, whatever the lengths
    p.open = 1.0 + (FRAME_OPENS if text.startswith(THAI_FRAMES, e) and _FRAME_HEAD.match(text, e, z) else 0.0)
    return True


def _score_mark(text: str, a: int, z: int, p: _Place, lower: frozenset | None) -> bool:
    """The scores of a place after a mark; ``lower`` has the opening words of a text without capitals. False if it can't divide at all."""
    at = p.at
    # the mark itself, before any closers
    k = at
    while k > a and (text[k - 1] in _CLOSERS or text[k - 1].isspace()):
        k -= 1
    m = k
    while m > a and (text[m - 1] in ";;" or _IS_MARK(text[m - 1])):
        m -= 1
    mark = text[m:k]
    behind = _NOT_SPACE.search(text, at, z)
    if not behind:
        return False  # the end of the piece
    tail = behind.start()
    rest = _NEXT.match(text, at, z)
    opener, word = rest.group(1), rest.group(2)
    spaced = tail > at
    first = word[:1]
    small = bool(first) and _SMALL.match(first) is not None
    capital = bool(first) and _CAPITAL.match(first) is not None
    digit = first.isdigit()
    caseless = bool(first) and not small and not capital and not digit
    native = _NATIVE(mark[-1]) is not None
    dots = "…" in mark or (len(mark) >= 3 and set(mark) == {"."})
    if (text[tail] in "—–-" and not digit) or text[tail] in ",;:،、，)":
        return False
    if not spaced and not native and mark[-1] not in _WIDE and p.quote is None:
        # a mark without a space behind it: a missed space only between a whole word and a capitalised one
        before = _WORD_BEFORE(text, a, m)
        b = before.group() if before else ""
        ok = capital and len(b) >= 2 and b[-1:].islower() and "." not in b and "_" not in text[max(a, m - 12) : m] and (len(word) == 1 or word[1].islower())
        if not ok and not (caseless and mark[-1] in "!?" and not dots):
            return False
        p.close, p.open = 3.0, 2.0
        return True
    close, open_ = 3.0, 2.0
    if small and lower is None and (opener.strip("¿¡") or not opener):
        close = HARDLY
    elif dots and caseless and (not spaced or _CJK.match(first)):
        close = HARDLY
    elif dots:
        close = 2.0 if lower is None or word not in CARRIERS else HARDLY
    if small and lower is not None and not dots:
        if word in CARRIERS:
            close += HARDLY if mark[-1] != "." or p.quote is not None else -0.5
        elif word in lower:
            open_ += 0.5
    if mark == ".":
        close += _before_stop(text, a, z, m, at, word, capital, digit, lower, opener)
    if p.quote is not None:
        head = text_rstrip(text, max(a, p.quote - 6), p.quote)
        if text[p.quote] in "([{（【":
            p.quote_mid = -6.0
        elif caseless or (first and not capital and not digit and not small):
            if text.startswith(QUOTE_CARRIERS, tail, z):
                p.quote_mid = p.quote_start = HARDLY
            elif _CJK.match(first or "x"):
                p.quote_start = HARDLY if not opener else 0.0
                p.quote_mid = 0.0 if text.endswith(SAYING, a, head) else HARDLY
        elif capital:
            second = _SECOND.match(text, rest.end(), z)
            if second and second.group(1) in SPEECH:
                p.quote_start = HARDLY
    p.close, p.open = close, open_
    return True


def _before_stop(text: str, a: int, z: int, m: int, at: int, word: str, capital: bool, digit: bool, lower: frozenset | None, opener: str) -> float:
    """How far the word before a full stop speaks against an end of sentence."""
    found = _WORD_BEFORE(text, a, m)
    raw = found.group() if found else ""
    w = raw.lower().strip(".-")
    if not w:
        return 0.0
    opens = word.lower() in (OPENERS if lower is None else lower)
    start = found.start()
    if w.isdigit():
        end = text_rstrip(text, a, start)
        if end == a:
            return HARDLY if len(w) <= 3 else 0.0
        prior = _WORD_BEFORE(text, a, end)
        pw = prior.group().lower().strip(".") if prior else ""
        return HARDLY if pw in BEFORE_ORDINAL and (capital or lower is not None) and not opens else 0.0
    # parts set apart by spaces: z. B., т. д., и т. п.
    joined = w
    if len(w) <= 2:
        k = text_rstrip(text, a, start)
        if k > a and text[k - 1] == ".":
            prior = _WORD_BEFORE(text, a, k - 1)
            if prior and len(prior.group()) <= 2:
                joined = prior.group().lower().strip(".") + "." + w
    follower = _INITIAL.match(text, at, min(z, at + 8))
    if joined in INNER or w in INNER:
        return HARDLY
    ends_ok = capital or digit or bool(opener) or (lower is not None and opens)
    if joined in ENDING or w in ENDING:
        if w in BEFORE_NUMBER and digit:
            return HARDLY
        if w in ("u.s", "e.u", "u.k", "u.n") and not opens:
            return HARDLY
        return -0.5 if ends_ok else HARDLY
    if w in BEFORE_NUMBER:
        if digit or (w in TITLES and capital):
            return HARDLY
        return 0.0 if len(w) > 1 or raw.islower() else HARDLY
    if w in TITLES:
        return HARDLY
    if len(w) == 1 and (raw[0].isupper() or follower or (lower is not None and len(word) > 1 and raw not in ("a", "i", "y", "o", "с", "г"))):
        return HARDLY
    if _LETTERS_AND_STOPS.fullmatch(w):
        return -0.5 if opens and (capital or lower is not None) else HARDLY
    return 0.0


_SECOND = regex.compile(r"\s+([\p{L}]+)")
_INITIAL = regex.compile(r"\s*\p{L}{1,2}\.")
_LETTERS_AND_STOPS = regex.compile(r"(?:\p{L}\.)+\p{L}")
_OPENS_HERE = regex.compile(r"(?:^|[!?]\s|\n\s*\n)\s*([\p{L}\p{M}]+)")


def _opening_words(text: str) -> frozenset:
    """The words that open a sentence in a text without capitals: function words, and what stands at the head of a paragraph or
    behind a mark of exclamation or question."""
    return frozenset(OPENERS | {w for w in _OPENS_HERE.findall(text) if w not in CARRIERS})


def text_rstrip(text: str, a: int, z: int) -> int:
    while z > a and text[z - 1].isspace():
        z -= 1
    return z


def _frame_only(text: str, a: int, z: int) -> bool:
    """A span of a script without marks that is a mere time or place: a framing word, a numeral and its unit."""
    s = text[a:z].strip()
    return s.startswith(THAI_FRAMES) and regex.fullmatch(rf"[{_THAI}\p{{M}}]{{1,12}}\s*[\p{{N}}.,:]+\s*[{_THAI}\p{{M}}]{{0,8}}", s) is not None


def _lengths(text: str, starts: list[int]) -> list[float]:
    """How far each place is from the first, in letters of an alphabet."""
    out = [0.0]
    a, z = starts[0], starts[-1]
    dense = [(r, x) for r, x in ((_CJK, CJK_EXTRA), (_THAI_CHAR, THAI_EXTRA)) if not text.isascii() and r.search(text, a, z)]
    for b, e in zip(starts, starts[1:]):
        out.append(out[-1] + e - b + sum(x * len(r.findall(text, b, e)) for r, x in dense))
    return out


def _length_score(n: float) -> float:
    """The log-prior of a span's length, 0 at the median."""
    return max(LEAST_LENGTH, -0.5 * (math.log(max(n, 1.0) / MEDIAN_LENGTH) / LENGTH_DEVIATION) ** 2)


class _Best:
    """The largest value among the starts of a range, added in their order: (value, start), the first of equal ones."""

    def __init__(self):
        self.at: list[int] = []
        self.top: tuple[float, int] = (-math.inf, -1)
        self._levels: list[list[tuple[float, int]]] = [[]]  # level k has the best of 2^k neighbours

    def add(self, start: int, value: float) -> None:
        self.at.append(start)
        item = (value, -start)
        self.top = max(self.top, item)
        level = self._levels[0]
        level.append(item)
        k = 0
        while len(level) % 2 == 0:
            pair = max(level[-2], level[-1])
            k += 1
            if k == len(self._levels):
                self._levels.append([])
            level = self._levels[k]
            level.append(pair)

    def among(self, low: int, high: int) -> tuple[float, int]:
        """Of the starts from ``low`` and below ``high``."""
        i, j = bisect_left(self.at, low), bisect_left(self.at, high)
        if i == 0 and j == len(self.at):
            return self.top
        best, k = (-math.inf, 1), 0
        while i < j:
            if i & 1:
                best = max(best, self._levels[k][i])
                i += 1
            if j & 1:
                j -= 1
                best = max(best, self._levels[k][j])
            i, j, k = i >> 1, j >> 1, k + 1
        return best


def _divide(text: str, a: int, z: int, lower: frozenset | None) -> list[int]:
    """Ends of the sentences of a piece, the last being its own end: the best division into whole spans."""
    places, left_open = _candidates(text, a, z, lower)
    places = [p for p in places if p.at < z]
    if not places:
        return [z]
    places.append(_Place(z, left_open))
    n = len(places)
    starts = [a, *(p.at for p in places)]
    opens = [0.0, *(p.open for p in places)]
    states = [0, *(p.state for p in places)]
    lengths = _lengths(text, starts)
    # where the first letter is, and where a quotation at the head of a span may be, seen from each start
    letter, lead = [z] * (n + 1), [z] * (n + 1)
    for i in range(n - 1, -1, -1):
        found = _LETTER.search(text, starts[i], starts[i + 1])
        letter[i] = found.start() if found else letter[i + 1]
        lead[i] = _BLANK_LEAD(text, starts[i], min(z, starts[i + 1] + 1)).end()
        if lead[i] > starts[i + 1]:
            lead[i] = max(lead[i], lead[i + 1])
    best, back = [0.0], [0]
    low = far = 0
    anywhere, by_state = _Best(), {}
    for j, p in enumerate(places, 1):
        at, state, quote, end = p.at, p.state, p.quote, p is places[-1]
        own = 0.0 if end else p.close - 1.0
        while far < j and lengths[j] - lengths[far] >= FAR:
            if far >= low:
                v = best[far] + opens[far]
                anywhere.add(far, v)
                by_state.setdefault(states[far], _Best()).add(far, v)
            far += 1
        top, arg = -math.inf, low
        if anywhere.at:
            # spans that are farther than FAR differ in their start's score and state, in having letters, and in where a quotation begins
            empty = bisect_left(letter, at, low, j)
            cuts = {low, far, min(max(empty, low), far)}
            if quote is not None:
                k1 = k0 = bisect_left(starts, quote + 1, low, j)
                while k0 > low and lead[k0 - 1] >= quote:
                    k0 -= 1
                cuts |= {min(k0, far), min(k1, far)}
            edges = sorted(cuts)
            for l, h in zip(edges, edges[1:]):
                more = LEAST_LENGTH + (EMPTY if l >= empty else 0.0)
                if quote is not None:
                    more += p.quote_start if l >= k0 else p.quote_mid
                v, i = anywhere.among(l, h)
                if v + more + UNBALANCED > top:
                    top, arg = v + more + UNBALANCED, -i
                if state in by_state:
                    v, i = by_state[state].among(l, h)
                    if v + more > top:
                        top, arg = v + more, -i
        for i in range(max(low, far), j):
            b = starts[i]
            v = best[i] + opens[i] + _length_score(lengths[j] - lengths[i])
            if states[i] != state:
                v += UNBALANCED
            if letter[i] >= at:
                v += EMPTY
            if p.space and _frame_only(text, b, at):
                v += EMPTY
            if quote is not None:
                v += p.quote_start if b > quote or lead[i] >= quote else p.quote_mid
            if v > top:
                top, arg = v, i
        best.append(top + own)
        back.append(arg)
        # a plain, strong and balanced end is in every best division: nothing before it needs to be looked at again
        if p.close + p.open >= CERTAIN and state == 0 and quote is None and not p.space and letter[arg] < at:
            low = far = j
            anywhere, by_state = _Best(), {}
    ends, j = [], n
    while j:
        ends.append(starts[j])
        j = back[j]
    return ends[::-1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Offsets of the sentences in code points, without white space at their edges. NULL, empty and blank texts have none."""
    if not text:
        return []
    lower = _opening_words(text) if _CAPITAL.search(text) is None and _SMALL.search(text) is not None else None
    out: list[tuple[int, int]] = []
    for a, z in _blocks(text):
        for s, e, item in _pieces(text, a, z):
            for stop in [e] if item else _divide(text, s, e, lower):
                b, t = s, stop
                while b < t and text[b].isspace():
                    b += 1
                while t > b and text[t - 1].isspace():
                    t -= 1
                if t > b:
                    out.append((b, t))
                s = stop
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: the key, sentence_no (from 0), start_char, end_char (code points, end exclusive) and sentence.

    Whole texts of any length; texts that are NULL, empty or blank give no row. Every row of the input is a document of its
    own, also where keys repeat or are NULL. An empty table gives no sentences; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    plain = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kt = plain.schema["key"].dataType
    schema = StructType([StructField("key", kt), StructField("sentence_no", IntegerType()), StructField("start_char", LongType()), StructField("end_char", LongType()), StructField("sentence", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key")
            row, no, start, stop, said = [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for n, (s, e) in enumerate(sentence_spans(t)):
                    row.append(k)
                    no.append(n)
                    start.append(s)
                    stop.append(e)
                    said.append(t[s:e])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(said, pa.string())], schema=arrow)

    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)

"""The grammar of one line of a raw transcript and the transformation of its parse tree.

    line       <- roster / head body
    roster     <- "#"? (heading word) [:-] equation ("," equation)* end
    equation   <- label ("is" / "=") label
    head       <- "<" label ">" stamp? / label stamp ":" / stamp? label (":" / dash) / stamp?
    stamp      <- "[" clock "]" / "(" seconds "s" ")" / clock ("-->" clock)?
    label      <- name remark?
    body       <- (annotation / filler / word / other)*
    annotation <- bracketed, starred or between notes; brackets nest

A label has at most four words; what is longer and ends in a colon is speech. Annotations are worked out once per place, from the right, so
a line takes time in proportion to its length however its brackets nest or fail to close. Expressions with a "+" behind a quantifier
never give back what they took, for the same reason.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import regex

from tapewright.llm.peg import Node, Source, at_one_of, choice, defer, many, maybe, memo, prepare, rule, run_of, seq, term, unless

# The seven fillers (um, uh, erm, hmm, mm, eh, ah), each of which may be drawn out or doubled and joined by hyphens. An "h" of
# one may begin an "hm".
_H = r"(?:h{2,}+m*+|hm{2,}+|h(?!m))"
FILLER = rf"(?:u++(?:m++|{_H})|e++(?:r++m++|{_H})|a++{_H}|h++m++|m{{2,}}+)"
_WORD_GOES_ON = r"(?![\p{L}\p{M}\p{N}'’])"
_FILLERS = rf"{FILLER}++{_WORD_GOES_ON}(?:[-–]{FILLER}++{_WORD_GOES_ON})*+"

NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}

ws = term(r"\s*")
gap = term(r"\s+")
end = term(r"\s*$")

_clock = rule("clock", term(r"\d{1,3}:\d{1,2}(?::\d{1,2})?(?:[.,]\d{1,9})?(?!\d)"))
_seconds = rule("seconds", term(r"\d+(?:[.,]\d{1,9})?"))
_stamp = rule(
    "stamp",
    choice(
        seq(term(r"\[\s*"), _clock, maybe(seq(term(r"\s*-+>\s*"), _clock)), term(r"\s*\]")),
        seq(term(r"\(\s*"), _seconds, term(r"\s*s\s*\)")),
        seq(_clock, maybe(seq(term(r"\s*-+>\s*"), _clock))),
    ),
)

_nested = defer(lambda: _annotation)
#: What may begin or end an annotation; between two of these nothing can.
_OPENS = "[({<*♪♫♬♩"
_OPENERS = regex.compile(rf"[{regex.escape(_OPENS)}]")
_plain = term(r"[^\[\](){}<>*♪♫♬♩]++")


def _inside(close: str):
    return run_of(choice(_plain, _nested, term(rf"[^{close}]")))


_bracketed = choice(
    seq(term(r"\["), _inside(r"\]"), term(r"\]")),
    seq(term(r"\("), _inside(")"), term(r"\)")),
    seq(term(r"\{"), _inside("}"), term(r"\}")),
    seq(term(r"<"), _inside(">"), term(r">")),
)
_between_notes = choice(term(r"(?<![♪♫♬♩])[♪♫♬♩]++[^♪♫♬♩]++[♪♫♬♩]++"), term(r"(?<![♪♫♬♩])[♪♫♬♩]++"))
_starred = term(r"(?<!\*)\*++[^*]++\*++")
_annotation = at_one_of(_OPENS, memo(rule("annotation", choice(_bracketed, _starred, _between_notes))))

_name_word = r"(?:[\p{L}][\p{L}\p{M}\p{N}'’_.-]*|\d{1,3}(?!\d|:\d))"
_name = rule("name", term(rf"{_name_word}(?:[ \t]+{_name_word}){{0,3}}"))
# Words that name sounds; between angle brackets they are no speakers.
SOUNDS = "noise|static|music|laughter|laughs?|laughing|applause|clapping|crosstalk|inaudible|unintelligible|silence|pause|sighs?|coughs?|beep|breath|breathing|cheering|clears throat"
# a remark behind a label is an annotation but no stamp
_label = seq(_name, many(seq(ws, unless(_stamp), _annotation)))
_short_name = rule("name", term(rf"{_name_word}(?:[ \t]+(?!(?:is|are)\b){_name_word}){{0,3}}", regex.I))
_equals = term(r"\s*(?:=+|\bis\b|\baka\b|\bequals\b|\bsame as\b)\s*", regex.I)
_equation = rule("equation", seq(_short_name, _equals, _short_name))
_roster = rule(
    "roster",
    seq(
        ws,
        term(r"#?\s*"),
        maybe(seq(term(r"(?:speakers?|voices?|cast|legend|labels?|who(?: is who)?|participants?|key)\b\s*[:–—-]?\s*", regex.I))),
        _equation,
        many(seq(term(r"\s*(?:[,;]|\band\b)\s*", regex.I), _equation)),
        term(r"\s*\.?"),
        end,
    ),
)

_sound = term(rf"(?:{SOUNDS})\b[^>]*>", regex.I)
_head = choice(
    seq(ws, term(r"<\s*"), unless(_sound), _label, term(r"\s*>"), maybe(seq(ws, _stamp)), term(r"\s*:?")),
    seq(ws, _label, gap, _stamp, term(r"\s*:")),
    seq(ws, _stamp, ws, term(r"<\s*"), unless(_sound), _label, term(r"\s*>\s*:?")),
    seq(ws, maybe(seq(_stamp, ws)), _label, choice(term(r"\s*:"), term(r"\s+[—–]\s"))),
    seq(ws, _stamp, term(r"\s*:?")),
    ws,
)
_filler = at_one_of("uehmaUEHMA", rule("filler", seq(term(_FILLERS, regex.I), term(r"[\s]*[-–—]*[.,…?!;:]*"))))
_word = rule("word", term(r"[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}]|['’.,_:/-](?=[\p{L}\p{N}]))*%?"))
_body = many(choice(_annotation, _filler, _word, term(r"\s+"), at_one_of(".,?!;:…", rule("mark", term(r"[.,?!;:…]+"))), term(r"(?s).")))
_not_spoken = regex.compile(r"[^\p{L}\p{M}\p{N}%]+")
_line = choice(_roster, seq(_head, rule("body", _body)))
_text = _body


def _source(text: str) -> Source:
    source = Source(text)
    prepare(source, _annotation, (m.start() for m in _OPENERS.finditer(text)))
    return source


@dataclass
class Line:
    second: int | None = None
    nanos: int | None = None  # NULL if the stamp is cut to the second
    label: str | None = None
    words: list[str] = field(default_factory=list)  # as spoken, with their marks
    plain: list[str] = field(default_factory=list)  # the same words in lower case without marks
    equal: list[tuple[str, str]] = field(default_factory=list)


def _seconds_of(text: str) -> tuple[int, int | None]:
    whole, _, part = text.replace(",", ".").partition(".")
    total = 0
    for unit in whole.split(":"):
        total = total * 60 + int(unit)
    return total, int(part.ljust(9, "0")[:9]) if part else None


@lru_cache(maxsize=65536)
def plain_label(name: str) -> str:
    """One spelling for case, separators, a trailing initial and the ways to write a numbered speaker."""
    low = regex.sub(r"[\s_.\-–]+", " ", name.lower()).strip()
    m = regex.fullmatch(r"([\p{L}]+) ?0*(\d+|[a-z]+)", low)
    if m:
        word, number = m.group(1), m.group(2)
        n = int(number) if number.isdigit() else NUMBER_WORDS.get(number)
        if n is not None and (word in ("speaker", "spkr", "spk", "s") or one_edit(word, "speaker")):
            return f"speaker {n}"
    low = regex.sub(r"(?<=\p{L}{2}) \p{L}$", "", low)
    return low


def one_edit(a: str, b: str) -> bool:
    """Equal but for one missing, extra, changed or doubled letter or one swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _spoken(text: str, nodes: tuple[Node, ...], into: Line) -> None:
    glue = -1
    for name, a, z, _ in nodes:
        if name == "word":
            into.words.append(text[a:z])
            into.plain.append(_not_spoken.sub("", text[a:z].lower()))
            glue = z
        elif name == "mark" and a == glue and into.words:
            into.words[-1] += text[a:z]


def parse_line(text: str | None) -> Line:
    """A raw line as its parts; a NULL or empty line has none."""
    out = Line()
    if not text:
        return out
    r = _line(_source(text), 0)
    if r is None:
        return out
    for name, a, z, children in r[1]:
        if name == "roster":
            for _, _, _, pair in children:
                left, right = (plain_label(text[n[1] : n[2]]) for n in pair if n[0] == "name")
                out.equal.append((left, right))
        elif name == "stamp":
            first = children[0]
            out.second, out.nanos = _seconds_of(text[first[1] : first[2]])
        elif name == "name":
            out.label = plain_label(text[a:z])
        elif name == "body":
            _spoken(text, children, out)
    return out


def spoken_words(text: str | None) -> list[str]:
    """The plain words of free speech: no fillers, no annotations, no marks."""
    out = Line()
    if text:
        _spoken(text, _text(_source(text), 0)[1], out)
    return out.plain

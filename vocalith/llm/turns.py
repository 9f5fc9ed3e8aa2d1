"""Clean speaker turns from labelled transcripts (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import once_per_id, spread

# Hesitations by language; those after the bar are also words there and go only where they stand alone.
FILLERS = {
    "": "uh um uhm umm uhh er erm hm hmm mhm mm eh ah ähm äh öh öhm euh heu em ehm э эм ээ эээ э-э мм хм yyy eee ee ehh 呃 嗯 额 えっと ええと あの",
    "de": "| um er eh ah",
    "es": "| ah",
    "pt": "| um em ah",
    "fr": "| ah",
    "pl": "| em ah",
}
# Sound annotations inside brackets or marks.
ANNOTATIONS = (
    "laughter laughs laughing laugh noise music door slams applause coughs cough coughing sighs sigh lipsmack breath breathing inhales "
    "crosstalk unintelligible inaudible silence click clicks beep ringing phone rings whispering clears throat sneezes background noise "
    "foreign indistinct pause static typing footsteps cheering sil spoken_noise crying gasps groans humming"
)
# Short forms of roles.
ROLES = {
    "agent": "agt ag", "customer": "cust cus", "moderator": "mod", "caller": "call", "interviewer": "int", "interviewee": "", "host": "",
    "guest": "gst", "operator": "op oper", "client": "cli", "chair": "", "doctor": "dr doc", "patient": "pat pt", "teacher": "", "student": "",
    "narrator": "narr", "participant": "part", "witness": "wit", "judge": "", "counsel": "", "presenter": "", "audience": "aud", "clerk": "",
}
_ROLE = {f: full for full, short in ROLES.items() for f in (full, *short.split())}
# Words that may stand before a colon without being a label.
NO_LABEL = frozenset("so note ready remark warning example time date subject re ps nb agenda topic question answer title chapter section that is sharp".split())

_CLOCK = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
#: A time that marks a stretch: in brackets, as seconds, as a range, or a long clock time without brackets.
TIME = re.compile(
    rf"\[\s*(?P<a>{_CLOCK}|\d+(?:\.\d+)?s?)(?:\s*(?:-->|-|–)\s*(?:{_CLOCK}|\d+(?:\.\d+)?s?))?\s*\]"
    rf"|\(\s*(?P<b>{_CLOCK}|\d+\.\d+s?)(?:\s*(?:-->|-|–)\s*(?:{_CLOCK}|\d+(?:\.\d+)?s?))?\s*\)"
    rf"|<\s*(?P<c>{_CLOCK}|\d+(?:\.\d+)?)(?:\s*(?:-->|-|–)\s*(?:{_CLOCK}|\d+(?:\.\d+)?))?\s*>"
    rf"|(?:(?:(?<=\n)|(?<=^))\d+[ \t]*\n)?(?P<d>\d{{1,2}}:\d\d(?::\d\d)?[.,]\d{{1,3}})[ \t]*-->[ \t]*\d{{1,2}}:\d\d(?::\d\d)?[.,]\d{{1,3}}"
    r"|(?<![\d:.,])(?P<e>\d{1,2}:\d\d:\d\d(?:[.,]\d{1,3})?)(?![\d:])"
)
# Words for a speaker, before a number or a letter.
SPEAKER = "speaker spkr spk sprecher locuteur hablante participant person voice".split()
_REST = re.compile(r"[\s_.#-]*(?:0*(\d+)|([a-z]))\.?$", re.I)
_ROLE_REST = re.compile(r"[\s_.]*(\d*)[\s.]*$")
_SHORT = re.compile(r"(?:s[\s_.#-]*)?0*(\d+)$|([a-z])$", re.I)
_NAME = re.compile(r"(?:(?:dr|mr|mrs|ms|prof)\.?\s+)?[^\W\d_][\w'’-]*\.?(?:\s+[^\W\d_][\w'’-]*\.?){0,2}$", re.I)


def seconds(clock: str) -> float:
    out = 0.0
    for part in clock.rstrip("s").replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All literal cues: marks that open or close labels, words for speakers and roles, hesitations and annotation words."""
    cues: dict[str, set] = {}
    for w in (*SPEAKER, *_ROLE):
        cues.setdefault(w, set()).add(("who", w))
    for c in (":", "[", "<v ", ">>"):
        cues.setdefault(c, set()).add(("cue", c))
    for lang, words in FILLERS.items():
        for w in words.replace("|", "").split():
            cues.setdefault(w, set()).add(("filler", lang))
    for w in ANNOTATIONS.split():
        for o, c in ("[]", "()", "<>", "{}", "**", "♪♪"):
            cues.setdefault(f"{o}{w}", set()).add(("note", c))
            cues.setdefault(f"{o} {w}", set()).add(("note", c))
    cues.setdefault("((", set()).add(("note", "))"))
    a = ahocorasick.Automaton()
    for k, v in cues.items():
        a.add_word(k, (k, tuple(sorted(v))))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _subtract(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) outside the sorted cuts."""
    out, at = [], start
    for a, b in cuts:
        if b <= at or a >= end:
            continue
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < end:
        out.append((at, end))
    return out


class _Label:
    __slots__ = ("end", "kind", "name", "start", "strong", "time")

    def __init__(self, start: int, end: int, name: str, kind: tuple[str, str] | None, strong: bool, time: float | None = None) -> None:
        self.start, self.end, self.name, self.kind, self.strong, self.time = start, end, name, kind, strong, time


class _Places:
    """Ascending positions in a text; the first one at or behind a position, and the last one before it."""

    def __init__(self, at: list[int]) -> None:
        self.at = at

    @classmethod
    def of(cls, text: str, mark: str) -> _Places:
        return cls([m.start() for m in re.finditer(re.escape(mark), text)])

    def next(self, i: int) -> int:
        k = bisect_left(self.at, i)
        return self.at[k] if k < len(self.at) else 1 << 60

    def last(self, i: int) -> int:
        k = bisect_left(self.at, i)
        return self.at[k - 1] if k else -1


def _kind(text: str, start: int, end: int, who: dict[int, list[str]]) -> tuple[str, str] | None:
    """The speaker that a label names by itself: a number, a letter or a role. ``who`` has the automaton's words by start."""
    while end > start and text[end - 1].isspace():
        end -= 1
    while start < end and text[start].isspace():
        start += 1
    for w in sorted(who.get(start, ()), key=len, reverse=True):
        at = start + len(w)
        if at > end or at < end and text[at].isalpha():
            continue
        rest = text[at:end]
        if w in SPEAKER and (m := _REST.match(rest)):
            return ("n", m[1]) if m[1] else ("l", m[2].lower())
        if w in _ROLE and (m := _ROLE_REST.match(rest)):
            return "r", _ROLE[w] + (f" {int(m[1])}" if m[1] else "")
    if m := _SHORT.match(text[start:end]):
        return ("n", m[1]) if m[1] else ("l", m[2].lower())
    return None


def _like_name(name: str) -> bool:
    parts = name.split()
    return bool(_NAME.match(name)) and all(p[0].isupper() for p in parts) and not (len(parts) == 1 and (len(name) < 3 or name.lower() in NO_LABEL))


#: The words of the longest label: a title and three names, and a mark before them.
LABEL_WORDS = 5


def _head(text: str, e: int, time_ends: dict) -> int:
    """Where the words before a colon at e begin: behind the line's start, another colon or a time, or LABEL_WORDS back."""
    i, words, inside = e, 0, False
    while i > 0 and i not in time_ends and text[i - 1] not in "\n:":
        blank = text[i - 1] in " \t"
        words += inside and blank
        if words > LABEL_WORDS:
            break
        inside = not blank
        i -= 1
    return i


def _labels(text: str, low: str, cues: list[tuple[int, str]], times: list[tuple[int, int, float]], who: dict[int, list[str]]) -> list[_Label]:
    """Labels in order. Context rules: where a label may stand, and what it may say. Every part of the text is looked at a
    bounded number of times, whatever the number of labels or the length of a line."""
    time_ends = {}
    for a, b, t in times:
        e = b
        while e < len(text) and text[e] in " \t\n":
            e += 1
        time_ends[e] = (a, t)
    begins, closers, lines = _Places([a for a, _, _ in times]), {c: _Places.of(text, c) for c in "]>"}, _Places.of(text, "\n")
    openers = {c: _Places([at for at, x in cues if x == c]) for c in ("[", "<v ")}
    time_of = {a: b for a, b, _ in times}
    out: list[_Label] = []
    size = len(text)
    for at, cue in cues:
        if cue in openers:
            end = closers["]" if cue == "[" else ">"].next(at)
            if end >= min(size, lines.next(at), openers[cue].next(at + 1)):
                continue  # it is not closed in its line
            a = at + len(cue)
            name, kind = text[a:end].strip(), _kind(text, a, end, who)
            if cue == "<v ":
                if name:
                    out.append(_Label(at, end + 1, name, kind, True))
                continue
            if not name or (t := begins.last(at + 1)) >= 0 and at < time_of[t] or all(w in _NOTE_WORDS for w in low[a:end].split()):
                continue
            head = _starts(text, at, time_ends)
            if kind or head and _like_name(name):
                e = end + 1
                if text.startswith(":", e):
                    e += 1
                out.append(_Label(at, e, name, kind, bool(kind) and (kind[0] != "l" or head) or head))
        elif cue == ":":
            if at + 1 < size and text[at - 1 : at].isdigit() and text[at + 1].isdigit():
                continue  # a clock time
            # The label ends before the colon, and before a time in brackets there.
            e, t = at, None
            while e > 0 and text[e - 1] in " \t":
                e -= 1
            if e > 0 and text[e - 1] in ")]":
                i = e - 1
                while i > 0 and (text[i - 1].isdigit() or text[i - 1] in ":., \t"):
                    i -= 1
                clock = text[i : e - 1].strip()
                if i > 0 and text[i - 1] in "[(" and re.fullmatch(_CLOCK + r"|\d+(?:\.\d+)?", clock):
                    e, t = i - 1, seconds(clock)
                    while e > 0 and text[e - 1] in " \t":
                        e -= 1
            lo = _head(text, e, time_ends)
            start = lo
            while start < e and text[start] in " \t->•*":
                start += 1
            name = text[start:e]
            kind = _kind(text, start, e, who)
            if name and _starts(text, lo, time_ends) and (kind or _like_name(name)):
                out.append(_Label(start, at + 1, name, kind, True, t))
            elif m := _INLINE.search(low, max(0, lo - 2), e):
                start = m.start(1)
                out.append(_Label(start, at + 1, text[start:e], _kind(text, start, e, who), True, t))
    out.sort(key=lambda x: (x.start, -x.end))
    kept: list[_Label] = []
    for x in out:
        if not kept or x.start >= kept[-1].end:
            kept.append(x)
    return kept


#: A label inside a line, behind the end of a sentence or a mark.
_INLINE = re.compile(r"(?:(?<=[.?!…\])>}♪*])|(?<=[.?!…\])>}♪*] ))((?:speaker|spkr|spk)[ _.-]*(?:\d+|[a-z])|s\d+)$")


def _starts(text: str, at: int, time_ends: dict) -> bool:
    """Whether a label may begin at the position: at the start of a line, after a time or after quote marks."""
    i = at
    while i > 0 and text[i - 1] in " \t>•-*":
        if i in time_ends:
            return True
        i -= 1
    return i == 0 or text[i - 1] == "\n" or i in time_ends or at in time_ends


_NOTE_WORDS = frozenset(ANNOTATIONS.split())


def _speakers(labels: list[_Label]) -> dict[str, tuple]:
    """The speaker behind each spelling of a record. Full names come first; then short forms join the first person they
    fit. Persons are looked up by their initials, or by a whole part of their name."""
    out: dict[str, tuple] = {}
    forms = []
    for x in labels:
        if x.name in out:
            continue
        if x.kind:
            out[x.name] = x.kind
        else:
            forms.append((x.name, [p.rstrip(".") for p in re.sub(r"^(?:dr|mr|mrs|ms|prof)\.?\s+", "", x.name.lower()).split()]))
            out[x.name] = ("p", -1)
    persons: list[list] = []  # given, family
    exact: dict[tuple, int] = {}
    initials: dict[tuple, list[int]] = {}
    parts: dict[str, list[int]] = {}

    def same(x: str | None, y: str | None) -> bool:
        return x is None or y is None or (x == y if min(len(x), len(y)) > 1 else x[:1] == y[:1])

    def enter(i: int) -> None:
        g, f = persons[i]
        exact.setdefault((g, f), i)
        initials.setdefault((g[:1], f and f[:1]), []).append(i)
        for p in {g, f} - {None}:
            parts.setdefault(p, []).append(i)

    full = lambda p: len(p) >= 2 and len(p[0]) > 1 and len(p[-1]) > 1
    for n, p in sorted(forms, key=lambda x: not full(x[1])):
        if not p:
            continue
        g, f = (p[0], p[-1]) if len(p) > 1 else (p[0], None)
        near = exact.get((g, f))
        if near is None and not full(p):
            if f is None:
                fits = (i for i in parts.get(g, ()) if g in persons[i])
            else:
                fits = (i for k in ((g[:1], f[:1]), (g[:1], None)) for i in initials.get(k, ()) if same(g, persons[i][0]) and same(f, persons[i][1]))
            near = min(fits, default=None)
        if near is None:
            near = len(persons)
            persons.append([g, f])
            enter(near)
        elif f is not None:  # the longer spelling of each part is kept
            q = persons[near]
            before = list(q)
            q[0] = g if len(g) > len(q[0]) else q[0]
            q[1] = f if q[1] is None or len(f) > len(q[1]) else q[1]
            if q != before:
                enter(near)
        out[n] = ("p", near)
    return out


def stretches(text: str, lang: str | None) -> list[tuple[float | None, str, str]]:
    """(time, speaker, clean words) of the labelled stretches as written; without words, they are left out."""
    low = _lower(text)
    cues, fillers, notes = [], [], []
    who: dict[int, list[str]] = {}
    for end, (word, kinds) in automaton().iter(low):
        at = end + 1 - len(word)
        for kind, what in kinds:
            if kind == "cue":
                cues.append((at, what))
            elif kind == "who":
                who.setdefault(at, []).append(what)
            elif kind == "filler":
                fillers.append((at, end + 1, what))
            else:
                notes.append((at, what))
    if not cues:
        return []
    times = []
    for m in TIME.finditer(text):
        s = next(x for x in m.groups() if x is not None)
        times.append((m.start(), m.end(), seconds(s)))
    labels = _labels(text, low, cues, times, who)
    if not labels:
        return []
    speaker = _speakers(labels)
    cuts = [(a, b) for a, b, _ in times] + [(x.start, x.end) for x in labels] + [(a, a + 2) for a, c in cues if c == ">>"]
    for m in re.finditer(r"(?m)^[ \t]*\d+[ \t]*(?=\n[ \t]*\d{1,2}:\d\d)", text):
        cuts.append(m.span())
    # An annotation goes to its closing mark, if no line, sentence or label ends or begins before that.
    closing = {c: _Places.of(low, c) for c in {c for _, c in notes}}
    stops = _Places(sorted([m.start() for m in re.finditer(r"\n|[.?!](?=\s)", low)] + [x.start for x in labels]))
    for at, close in notes:
        end = closing[close].next(at + 1)
        if end < min(stops.next(at + 1), len(low)):
            cuts.append((at, end + len(close)))
    base = (lang or "").lower()[:2]
    spans: dict[tuple[int, int], set] = {}
    for a, b, what in fillers:
        if (a and (low[a - 1].isalnum() or low[a - 1] in "'’-")) or (b < len(low) and (low[b].isalnum() or low[b] in "'’-")):
            if not "一" <= low[a] <= "鿿":
                continue
        spans.setdefault((a, b), set()).add(what)
    alone = []
    for (a, b), what in spans.items():
        e = b
        while e < len(text) and text[e] in ".…,":
            e += 1
        (alone if base in what else cuts).append((a, e))
    cuts.sort()
    alone.sort()
    out: list[tuple[float | None, str, str]] = []
    last: float | None = None
    prev = k = c = 0
    for x, nxt in zip(labels, [*labels[1:], None], strict=True):
        end = nxt.start if nxt else len(text)
        while k < len(times) and times[k][0] < x.start:
            k += 1
        t = x.time
        if t is None and k and times[k - 1][0] >= prev and not text[times[k - 1][1] : x.start].strip(" \t\n>•-*"):
            t = times[k - 1][2]
        prev = x.end
        last = t = last if t is None else t
        while c < len(cuts) and cuts[c][1] <= x.end and cuts[c][0] < x.end:
            c += 1
        d = c
        while d < len(cuts) and cuts[d][0] < end:
            d += 1
        parts = _subtract(x.end, end, cuts[c:d])
        words = " ".join(" ".join(text[a:b] for a, b in parts).split())
        rest = " ".join(" ".join(text[a:b] for p in parts for a, b in _subtract(*p, alone[bisect_left(alone, (p[0], 0)) : bisect_left(alone, (p[1], 0))])).split())
        if any(c.isalnum() for c in rest):  # an ambiguous word counts as a hesitation where nothing else stands
            out.append((t, "/".join(map(str, speaker[x.name])), words.strip(" ,-")))
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, k, *s) for i, t, g in zip(pdf["id"], pdf["text"], pdf["lang"], strict=True) for k, s in enumerate(stretches(t, g))]
        yield pd.DataFrame(rows, columns=["id", "seq", "at", "speaker", "words"])


def speaker_turns(sup: DataFrame) -> DataFrame:
    """(id, turn_no, speaker_no, start_sec, text): clean turns of each supervision whose text has speaker labels.

    One automaton finds marks, hesitations and annotations; context rules decide which marks are labels; what is left
    of a stretch after subtracting times, labels, hesitations and annotations is its words. Windows per supervision
    order the stretches by time (as written where they have none), drop nothing further, and number turns and speakers.

    A stretch without words vanishes. Null and empty texts, and texts without labels, give no rows; ids delivered
    again count once. ``start_sec`` is null if the record has no times. A window holds one text's stretches only.
    """
    rows = sup.where(F.col("text").isNotNull() & F.col("text").rlike(r":|<[vV] |\["))
    rows = once_per_id(rows, "text", "lang")
    st = spread(rows, "id").mapInPandas(_parse, "id string, seq int, at double, speaker string, words string")
    order = Window.partitionBy("id").orderBy(F.col("at").asc_nulls_first(), "seq")
    st = st.withColumn("new", F.coalesce((F.lag("speaker").over(order) != F.col("speaker")).cast("int"), F.lit(1)))
    st = st.withColumn("turn_no", F.sum("new").over(order).cast("int"))
    st = st.withColumn("first", F.min("turn_no").over(Window.partitionBy("id", "speaker")))
    st = st.withColumn("speaker_no", F.dense_rank().over(Window.partitionBy("id").orderBy("first")))
    turn = F.array_sort(F.collect_list(F.struct("at", "seq", "words")))
    return st.groupBy("id", "turn_no", "speaker_no").agg(F.min("at").alias("start_sec"), turn.alias("w")).select(
        "id", "turn_no", "speaker_no", "start_sec", F.array_join("w.words", " ").alias("text")
    )

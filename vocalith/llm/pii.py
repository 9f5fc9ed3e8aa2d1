"""Personal information inside free text (problem 10): a character tagger finds the spans, patterns settle their ends."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalith.llm import forms, tagger
from vocalith.llm.encode import _pieces

KINDS = ("email", "phone", "idnum", "address", "name")
TAG = {k: i + 1 for i, k in enumerate(KINDS)}
#: Pieces of documents that the tagger is fitted on, at most, their characters, and the windows taken from them.
FIT_DOCUMENTS, PIECE, FIT_WINDOWS = 3000, 2000, 9000
#: Cells of each direction, characters of a window for fitting, and steps.
HIDDEN, FIT_SIZE, STEPS = 24, 96, 450
WINDOW, STRIDE = 256, 224
#: Taken from the score of "outside" when decoding.
CAUTION = 0.5

# Words of numbers, of streets and of directions.
DIGIT = "zero oh one two three four five six seven eight nine".split()
TENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split()
STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|court|ct|drive|dr|boulevard|blvd|place|pl|square|sq|terrace|way|crescent|close|highway|hwy)"
_W = r"[^\W\d_][\w'’-]*"
_NUMBER_WORD = "(?:" + "|".join(DIGIT + TENS) + ")"

EMAIL = re.compile(
    r"[A-Za-z0-9À-ɏ_.+%-]*[A-Za-z0-9À-ɏ_]@[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*(?:\.[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*)+"
    r"|[A-Za-z0-9À-ɏ_.+%-]*[A-Za-z0-9À-ɏ_]\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*)+"
    r"|[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_+-]*(?:\s(?:dot|plus|underscore|dash|hyphen)\s[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_+-]*)*\sat\s[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*(?:\sdot\s[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ_-]*)+",
    re.I,
)
_KEY = re.compile(
    r"(?:passport|passeport|pasaporte|national id|id number|identity|tax|social security|ssn|ausweis\w*|steuer\w*|paszport\w*|dowod\w*|pesel|nip|dni|nif|"
    r"паспорт\w*|снилс|инн|sécurité sociale|numéro fiscal|número fiscal|identidad|seguro social|身份证\w*|护照\w*|税号)[^\n\d]{0,24}$",
    re.I,
)
_DECOY = re.compile(r"(?:order|ticket|version|utterance|frame|cut|build|invoice no|bestellung|commande|pedido|item|room|page|port|http\S*|order no|no|nr)\.?\s*#?\s*$", re.I)
_NUMERIC = re.compile(
    r"(?P<idnum>(?<![A-Za-z0-9_.-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}|ID-\d{3,5}-\d{2,4}-[A-Z\d]|[A-Z]{2} ?\d{7}|\d{8}-?[A-Z])(?![A-Za-z0-9_-]))"
    r"|(?P<phone>(?<![A-Za-z0-9_.])(?:\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){2,6}|(?<!\d )\d?[ -]?\(\d{3}\) ?\d{3}[ -]\d{4}|\(0\d{1,4}\)[ \d/-]{5,12}\d|\d[ -]\d{3}[ -]\d{3}[ -]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}"
    r"|0\d(?:[ .-]\d\d){4}|0\d{2,4} \d{3,4} \d{3,4}|0\d{2,4}[/ -]\d{3,6}-\d{1,4}|0\d{2,4}/\d{4,9}|0\d{2,4} \d{5,8}|\d{3}-\d{4})(?![A-Za-z0-9_]|-\d))"
    r"|(?P<bare>(?<![A-Za-z0-9_.+/-])\d{7,14}(?![A-Za-z0-9_-]|[.,:]\d))",
    re.I,
)
_SPOKEN = re.compile(r"\b(?:plus )?(?:(?:" + "|".join(DIGIT + ["double", "triple"]) + r")[ -]){5,}(?:" + "|".join(DIGIT) + r")\b", re.I)
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:\d{{1,5}}[a-z]?|{_NUMBER_WORD}(?:[ -]{_NUMBER_WORD}){{0,3}})\s(?:(?:north|south|east|west|n|s|e|w)\.?\s)?(?:{_W}\s){{1,3}}?{STREET}\b"
    rf"|(?<![\w.,/-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|route|passage|square) (?:d[eu]s? (?:la |l['’])?|d['’]|l['’])?{_W}"
    rf"|\b[^\W\d_]{{2,}}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer)\s\d{{1,4}}[a-z]?\b"
    rf"|\b(?:straße|strasse|weg|gasse|platz|allee|am|an der) [^\W\d_]+ \d{{1,4}}[a-z]?\b"
    rf"|(?<!\w)(?:ul|al|pl|os)\.\s?{_W}(?:\s{_W})?\s\d{{1,4}}[a-z]?(?:/\d{{1,4}})?\b"
    rf"|(?<!\w)(?:ул|пр|просп|пер|пл|наб)\.\s?{_W}(?:\s{_W})?,?\s(?:д\.\s?)?\d{{1,4}}"
    rf"|(?<!\w)(?:улица|проспект|переулок)\s{_W},?\s(?:д\.|дом)?\s?\d{{1,4}}"
    rf"|(?<!\w)(?:calle|avenida|avda\.|av\.|plaza|paseo|camino|carretera|c/)\s?(?:d[e](?:l| la| los| las)?\s)?{_W}(?:\s{_W})?,?\s(?:n\.?[ºo°]?\s?|núm(?:ero)?\.?\s|número\s)?\d{{1,4}}"
    r"|[一-鿿]{1,8}(?:路|街|道|巷)\s?\d{1,5}\s?号",
    re.I,
)
_TOKEN = re.compile(r"[A-Za-zÀ-ɏͰ-ԯ][A-Za-zÀ-ɏͰ-ԯ'’-]*\.?")
#: Words before a name, or after it, that say that it is one.
_CUE_BEFORE = re.compile(r"(?:name is|name ist|this is|ask for|sent by|item for|thanks a lot,?|spricht|je suis|ici|habla|llamo|nazywam się|mówi|зовут|говорит|我叫|我是|dr\.|mr\.|mrs\.|ms\.|prof\.|herr|frau|pan|pani|señora?|m\.|mme)\s*$", re.I)
_CUE_AFTER = re.compile(r"\s*(?::|joined|speaking|at the desk|before friday|au téléphone|de la oficina)", re.I)


def view(text: str) -> tuple[str, list[int] | None]:
    """The text in one form of its characters, and for each of its characters the position in the text (None: the same)."""
    if text.isascii() or not (forms.ODD.search(text) or forms.FOREIGN.search(text)):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        r = forms.PLAIN.get(ord(c), c) if c not in "\n\t\r" else c
        for x in r or "":
            out.append(x)
            at.append(i)
    s = "".join(out)
    if forms.FOREIGN.search(s):
        for m in re.finditer(r"[^\W\d_]+", s):
            w = m[0]
            if forms.FOREIGN.search(w) and not forms.is_plain(w):
                out[m.start() : m.end()] = [chr(forms.LOOK[ord(c)]) if isinstance(forms.LOOK.get(ord(c)), int) else (forms.LOOK.get(ord(c)) or c)[:1] for c in w]
        s = "".join(out)
    at.append(len(text))
    return s, at


class Checker:
    """The exact check: where an entity of a kind lies in a stretch of text."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def numbers(self, s: str) -> list[tuple[int, int, str]]:
        out = []
        for m in _NUMERIC.finditer(s):
            kind = m.lastgroup
            head = s[max(0, m.start() - 44) : m.start()]
            keyed = bool(_KEY.search(head))
            digits = re.sub(r"\D", "", m[0])
            a = m.start() + len(m[0]) - len(m[0].lstrip(" -"))
            if not keyed and _DECOY.search(head) and not m[0].startswith(("+", "(")):
                if not re.search(r"(?:phone|tel|fax|call|mobile)\W*(?:no|nr)\.?\s*$", head, re.I):
                    continue
            if kind == "bare":
                kind = "idnum" if keyed or len(digits) in (9, 11) else "phone" if len(digits) in (7, 10) or digits[0] == "0" and len(digits) < 13 else None
            elif kind == "phone" and not 7 <= len(digits) <= 15:
                continue
            elif kind == "phone" and keyed:
                kind = "idnum"
            if kind:
                out.append((a, m.end(), kind))
        out += [(m.start(), m.end(), "phone") for m in _SPOKEN.finditer(s)]
        return out

    def names(self, s: str, tagged=None) -> list[tuple[int, int, str]]:
        """Given and family name in either order, an initial for the given name, an initial between them.

        One of the two has to be a known part. The other is known too, or looks like a name (case as its partner) in a
        place where names stand, or was tagged as a name.
        """
        toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(s)]
        out: list[tuple[int, int, str]] = []
        i = 0
        while i < len(toks):
            hit = self._name_at(s, toks, i, tagged)
            if hit:
                out.append((toks[i][0], toks[hit - 1][1] - toks[hit - 1][2].endswith("."), "name"))
                i = hit
            else:
                i += 1
        return out

    def _name_at(self, s: str, toks: list, i: int, tagged) -> int | None:
        a, b, w = toks[i]
        low = w.lower()

        def gap(j: int) -> str:
            return s[toks[j - 1][1] : toks[j][0]] if j < len(toks) else "?"

        def blank(j: int) -> bool:
            g = gap(j)
            return 0 < len(g) <= 3 and g.strip("  \n") == ""

        def initial(j: int) -> bool:
            return j < len(toks) and len(toks[j][2]) == 2 and toks[j][2][1] == "." and toks[j][2][0].isalpha()

        def touching(j: int) -> bool:
            return j < len(toks) and (gap(j) == "" or blank(j))

        def word(j: int) -> str:
            return toks[j][2].lower().rstrip(".")

        if w.endswith(".") and len(w) != 2:
            return None if not self._ends(low) else None
        if len(w) == 2 and w[1] == ".":  # an initial or two, then a known family name
            j = i + 1
            if initial(j) and touching(j):
                j += 1
            if j < len(toks) and touching(j) and word(j) in self.family and w[0].isupper():
                return j + 1
            return None
        j = i + 1
        if initial(j) and blank(j):
            j += 1
        if j < len(toks) and blank(j) and len(word(j)) > 1:
            x, y = low, word(j)
            g, f = x in self.given, y in self.family
            if g and f:
                return j + 1
            if (g or f) and self._fits(s, toks, i, j, tagged, g, f):
                return j + 1
            if j == i + 1 and x in self.family and y in self.given and not self._takes_family(s, toks, j):
                return j + 1
        if i + 1 < len(toks) and re.fullmatch(r",[  ]", gap(i + 1)):  # the family name first
            x, y = low, word(i + 1)
            if x in self.family and y in self.given and not self._takes_family(s, toks, i + 1):
                j = i + 2
                return j + 1 if initial(j) and blank(j) and toks[j][2][0].isupper() else j
        return None

    def _ends(self, low: str) -> bool:
        return low.rstrip(".") in self.family

    def _takes_family(self, s: str, toks: list, j: int) -> bool:
        """Whether the given name at j goes with a family name after it."""
        k = j + 1
        if k < len(toks) and len(toks[k][2]) == 2 and toks[k][2].endswith("."):
            k += 1
        return k < len(toks) and s[toks[k - 1][1] : toks[k][0]] == " " and toks[k][2].lower().rstrip(".") in self.family

    def _fits(self, s: str, toks: list, i: int, j: int, tagged, g: bool, f: bool) -> bool:
        x, y = toks[i][2], toks[j][2].rstrip(".")
        other, (oa, ob) = (y, toks[j][:2]) if g else (x, toks[i][:2])
        if len(other) < 3 or not (other[0].isupper() or tagged is not None and other.islower()) or other.lower() in _COMMON:
            return False
        before = bool(_CUE_BEFORE.search(s[max(0, toks[i][0] - 24) : toks[i][0]])) or toks[i][0] == 0 or s[toks[i][0] - 1] == "\n"
        after = bool(_CUE_AFTER.match(s[toks[j][1] : toks[j][1] + 20]))
        if tagged is None:
            return before and after
        share = tagged[oa:ob].mean() if ob > oa else 0
        return share > 0.7 and (before or after) and other[0].isupper() == (x if g else y)[0].isupper()

    def find(self, s: str, tagged=None) -> list[tuple[int, int, str]]:
        """All entities of a stretch, without overlaps: e-mail first, then address, numbers and names."""
        out: list[tuple[int, int, str]] = [(*m.span(), "email") for m in EMAIL.finditer(s)]
        free = lambda a, b: all(b <= x or a >= y for x, y, _ in out)
        out += [(*m.span(), "address") for m in ADDRESS.finditer(s) if free(*m.span())]
        out += [x for x in self.numbers(s) if free(x[0], x[1])]
        out += [x for x in self.names(s, tagged) if free(x[0], x[1])]
        return sorted(out)


_COMMON = frozenset("the a an and but or this that is are was ici habla der die das ein eine und oder mit von une un le la les des je suis el los las una dr mr mrs ms mein meine mon ma mi mój moje mówi hier spricht studio lake".split())


def learn_parts(texts: list[str], given: set[str], family: set[str]) -> tuple[set[str], set[str]]:
    """More name parts from texts: words that mostly stand before a known family name, or after a known given name."""
    given, family = set(given), set(family)
    words: Counter = Counter()
    for t in texts:
        words.update(re.findall(r"[^\W\d_]+", t))
    for _ in range(2):
        as_given, as_family = {}, {}
        for t in texts:
            for m in re.finditer(r"\b([A-Z][\w'’-]+) (?:[A-Z]\. )?(?=([A-Z][\w'’-]+)\b)", t):
                x, y = m[1].lower(), m[2].lower()
                if y in family and x not in given:
                    as_given.setdefault(m[1], Counter())[y] += 1
                if x in given and y not in family:
                    as_family.setdefault(m[2], Counter())[x] += 1
        for found, to in ((as_given, given), (as_family, family)):
            for w, partners in found.items():
                if len(partners) >= 3 and sum(partners.values()) >= 0.3 * words[w] and w.lower() not in _COMMON:
                    to.add(w.lower())
    return given, family


def _new_name(r: random.Random) -> str:
    syl = "an bel cor dal el fen gar hol is jor kel lin mar nor ol per qua ris sol tor ul ver wyn yar zel".split()
    return "".join(r.choice(syl) for _ in range(r.choice((2, 2, 3)))).capitalize()


_LETTERS = re.compile(r"[A-Za-zÀ-ɏͰ-ԯ]+(?:['’-][A-Za-zÀ-ɏͰ-ԯ]+)*")


def _inputs(s: str, flags: dict[str, int]) -> np.ndarray:
    """The tagger's inputs: the class of each character, and whether its word is a listed name part."""
    x = tagger.char_classes(s).astype(np.int16)
    for m in _LETTERS.finditer(s):
        if k := flags.get(m[0].lower()):
            x[m.start() : m.end()] += k * tagger.V
    return x


#: What may be taken for an entity: digits, signs of mail, two words with capitals.
_HARD = re.compile(r"[\d@(\[]|[A-ZÀ-Þ]\w+ [A-ZÀ-Þ]\w+")


def _flags(given: set[str], family: set[str]) -> dict[str, int]:
    return {w: (w in given) + 2 * (w in family) for w in given | family}


def fit(texts: list[str], given: set[str], family: set[str]) -> dict:
    """Tagger and name parts, from a bounded sample of texts.

    The labels of the sample are made by patterns and by the given list with what ``learn_parts`` adds to it from the
    sample; only the list itself goes into the tagger's input. Every third name is replaced by an invented one of the same
    form, so that the tagger learns the places of names and not only the list. As many windows without any span as half of
    those with one are taken, those with digits, signs of mail or capitals first.
    """
    r = random.Random(11)
    check = Checker(*learn_parts(texts, given, family))
    flags = _flags(given, family)
    pos, neg = [], []
    for t in texts:
        s, _ = view(t)
        spans = check.find(s)
        if spans:
            new, at, moved = [], 0, []
            shift = 0
            for a, b, k in spans:
                new.append(s[at:a])
                x = s[a:b]
                if k == "name" and r.random() < 0.33:
                    x = re.sub(r"[^\W\d_]{3,}", lambda m: (lambda n: n.upper() if m[0].isupper() else n.lower() if m[0].islower() else n)(_new_name(r)), x)  # noqa: B023
                new.append(x)
                moved.append((a + shift, a + shift + len(x), k))
                shift += len(x) - (b - a)
                at = b
            s = "".join([*new, s[at:]])
            spans = moved
        y = np.zeros(len(s), dtype=np.int64)
        for a, b, k in spans:
            y[a:b] = TAG[k]
        x = _inputs(s, flags).astype(np.int64)
        for at in range(0, max(1, len(s)), FIT_SIZE // 2):
            wx, wy = np.zeros(FIT_SIZE, dtype=np.int64), np.zeros(FIT_SIZE, dtype=np.int64)
            part = x[at : at + FIT_SIZE]
            wx[: len(part)], wy[: len(part)] = part, y[at : at + FIT_SIZE]
            hard = bool(_HARD.search(s[at : at + FIT_SIZE]))
            (pos if wy.any() else neg).append((wx, wy, not hard, r.random()))
    for x in (pos, neg):
        x.sort(key=lambda w: w[2:])
    r.shuffle(pos)
    take = pos[: FIT_WINDOWS * 2 // 3]
    take += neg[: max(64, len(take) // 2)]
    if not pos:
        model = tagger.new_model(HIDDEN, len(KINDS) + 1)
    else:
        model = tagger.fit(np.stack([w[0] for w in take]), np.stack([w[1] for w in take]), len(KINDS) + 1, HIDDEN, STEPS)
    return {"model": model, "given": given, "family": family}


def tag_texts(model: dict, texts: list[str], flags: dict[str, int], caution: float = CAUTION) -> list[np.ndarray]:
    """The tag of each character. Windows overlap; a character takes its tag from the window where it is furthest from an edge."""
    classes = [_inputs(t, flags) for t in texts]
    where, rows = [], []
    for i, c in enumerate(classes):
        at = 0
        while True:
            part = c[at : at + WINDOW]
            if len(part):
                row = np.zeros(WINDOW, dtype=np.int16)
                row[: len(part)] = part
                rows.append(row)
                where.append((i, at))
            if at + WINDOW >= len(c):
                break
            at += STRIDE
    out = [np.zeros(len(c), dtype=np.int8) for c in classes]
    edge = (WINDOW - STRIDE) // 2
    for b in range(0, len(rows), 512):
        got = tagger.decode(model, np.stack(rows[b : b + 512]), outside=caution)
        for (i, at), tags in zip(where[b : b + 512], got, strict=True):
            lo = edge if at else 0
            n = len(out[i])
            hi = WINDOW if at + WINDOW >= n else WINDOW - edge
            out[i][at + lo : min(n, at + hi)] = tags[lo : min(hi, n - at)]
    return out


def _runs(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """The spans that the tagger found: maximal runs of one kind."""
    cut = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    return [(a, b, KINDS[tags[a] - 1]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if tags[a]]


def _whole_words(s: str, a: int, b: int) -> tuple[int, int]:
    """A span without blanks and signs at its ends, and with the words whole that it covers by half."""
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    for m in _LETTERS.finditer(s, max(0, a - 40), min(len(s), b + 40)):
        x, y = m.span()
        if x < a < y:
            a = x if 2 * (y - a) >= y - x else y
        if x < b < y:
            b = y if 2 * (b - x) >= y - x else x
    return a, b


_SPOKEN_SIGN = re.compile(r"\s(?:at|dot)\s", re.I)
_NUMBERS = re.compile(r"\b(?:" + "|".join(DIGIT) + r")\b", re.I)


_WORD_BEFORE = re.compile(r"[^\W\d_][\w'’-]*[.,]?[ \xa0]$")
_WORD_AFTER = re.compile(r",?[ \xa0][^\W\d_][\w'’-]*")


def well_formed(x: str, kind: str, flags: dict[str, int]) -> bool:
    """Whether a span of the tagger that no pattern knows can be an entity of its kind at all."""
    if "\n" in x:
        return False
    digits = sum(c.isdigit() for c in x)
    if kind == "name":
        parts = [w for w in re.split(r"[\s,]+", x) if w]
        if not 2 <= len(parts) <= 4 or digits or not all(w.rstrip(".").replace("-", "").replace("'", "").replace("’", "").isalpha() for w in parts):
            return False
        long = [w for w in parts if len(w.rstrip(".")) > 1]
        return len(long) > 0 and all(w[0].isupper() and w.lower() not in _COMMON for w in long) and (len(long) > 1 or parts[0].endswith("."))
    if kind == "email":
        return ("@" in x and "." in x.partition("@")[2]) or len(_SPOKEN_SIGN.findall(x)) > 1
    if kind == "phone":
        return 7 <= digits <= 15 or len(_NUMBERS.findall(x)) >= 6
    if kind == "idnum":
        return 6 <= digits <= 16
    return 0 < digits < 7 and sum(c.isalpha() for c in x) > 3


def settle(s: str, tags: np.ndarray, check: Checker, flags: dict[str, int]) -> list[tuple[int, int, str]]:
    """The entities of a text from the tags of its characters.

    Every entity is a run of the tagger. Where a pattern finds an entity of that kind too, the pattern says where it begins and
    ends, and which of the two numbers it is, phone or identity, if at least two fifths of it are in that run and at
    least half of the run is in such entities. Where there are none, the run itself counts, brought to whole words, if it is well formed. The patterns read whole lines with a run, and the
    lines next to them; what they find elsewhere is nothing.
    """
    runs = _runs(tags)
    if not runs:
        return []
    lines = np.flatnonzero(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10)
    areas: list[list[int]] = []
    for a, b, _ in runs:
        i, j = int(np.searchsorted(lines, a)), int(np.searchsorted(lines, b))
        lo, hi = (int(lines[i - 2]) + 1 if i > 1 else 0), (int(lines[j + 1]) if j + 1 < len(lines) else len(s))
        if areas and lo <= areas[-1][1]:
            areas[-1][1] = max(hi, areas[-1][1])
        else:
            areas.append([lo, hi])
    # A name of which one part was found may have its other part in the next word.
    near = tags == TAG["name"]
    for a, b, k in runs:
        if k == "name":
            before, after = _WORD_BEFORE.search(s, max(0, a - 40), a), _WORD_AFTER.match(s, b)
            near[before.start() if before else a : after.end() if after else b] = True
    known = [(a + lo, b + lo, k) for lo, hi in areas for a, b, k in check.find(s[lo:hi], near[lo:hi])]
    covered = np.zeros(len(s), dtype=bool)
    for a, b, _ in known:
        covered[a:b] = True
    out = set()
    for a, b, k in runs:
        if 2 * int(covered[a:b].sum()) >= b - a:
            out.update(x for x in known if 5 * (min(b, x[1]) - max(a, x[0])) >= 2 * (x[1] - x[0]) and (x[2] == k or {k, x[2]} == {"phone", "idnum"}))
        else:
            x, y = _whole_words(s, a, b)
            # Taken for another kind, two words with capitals are still a name.
            if x < y and not covered[x:y].any() and (k := next((q for q in (k, "name") if well_formed(s[x:y], q, flags)), None)):
                out.add((x, y, k))
    return sorted(out)


def detect(fitted: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in code points of each text."""
    check, flags = Checker(fitted["given"], fitted["family"]), _flags(fitted["given"], fitted["family"])
    views = [view(t or "") for t in texts]
    out = []
    for (s, at), tags in zip(views, tag_texts(fitted["model"], [v for v, _ in views], flags), strict=True):
        found = settle(s, tags, check, flags)
        if at is not None:
            found = sorted((at[a], at[b - 1] + 1, k) for a, b, k in found)
        out.append(found)
    return out


def fit_on(docs: DataFrame, name_parts: DataFrame, documents: int = FIT_DOCUMENTS) -> dict:
    """The fitted tagger and the listed name parts. The sample is of at most ``documents`` pieces of at most PIECE characters,
    chosen by hash, so what the driver gets is bounded in bytes too. Only fitting uses the sample."""
    d = docs.where("doc_id is not null and length(text) > 0")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")), lambda i: F.substring("text", i * PIECE + 1, F.lit(PIECE)))
    d = d.select("doc_id", F.posexplode(pieces).alias("i", "text")).withColumn("h", F.xxhash64("doc_id", "i"))
    n = d.agg(F.count("*")).first()[0]
    share = F.pmod("h", F.lit(1 << 20)) / (1 << 20) < min(1.0, 1.3 * documents / max(1, n))
    some = d.where(share).orderBy("h", "doc_id", "i").limit(documents)
    parts = {k: {r["name_part"].lower() for r in name_parts.where(F.col("part_kind") == k).where("name_part is not null").collect()} for k in ("given", "family")}
    return fit([r["text"] for r in some.select("text").collect()], parts["given"], parts["family"])


def find_personal(docs: DataFrame, name_parts: DataFrame, fitted: dict | None = None) -> DataFrame:
    """(doc_id, kind, start_char, end_char): every e-mail address, phone number, identity number, street address and name.

    Positions count code points. The tagger reads every text as a whole; null and empty texts have no rows, repeated
    texts have rows for each document. ``name_parts`` is a fixed list of name parts and may be incomplete or empty.
    """
    got = fitted or fit_on(docs, name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 400):
                p = pdf.iloc[lo : lo + 400]
                rows = [(i, k, a, b) for i, spans in zip(p["doc_id"], detect(got, list(p["text"])), strict=True) for a, b, k in spans]
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_char", "end_char"])

    d = _pieces(docs.where(F.length("text") > 0).select("doc_id", "text"))
    return d.mapInPandas(run, "doc_id bigint, kind string, start_char bigint, end_char bigint").distinct()


def mask_personal(docs: DataFrame, name_parts: DataFrame, fitted: dict | None = None) -> DataFrame:
    """(doc_id, text, n_masked): texts with typed placeholders such as ``[EMAIL]``, the rest unchanged; null stays null."""
    got = fitted or fit_on(docs, name_parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 400):
                p = pdf.iloc[lo : lo + 400]
                texts, counts = [], []
                for t, spans in zip(p["text"], detect(got, list(p["text"])), strict=True):
                    for a, b, k in reversed(spans):
                        t = f"{t[:a]}[{k.upper()}]{t[b:]}"
                    texts.append(t)
                    counts.append(len(spans))
                yield pd.DataFrame({"doc_id": p["doc_id"], "text": texts, "n_masked": counts})

    return _pieces(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, text string, n_masked int")

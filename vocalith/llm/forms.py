"""Characters that look alike, are invisible, or have several encodings."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts and the Latin letter that looks the same.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮаеорсухѕіјһԁԛԝӀӏ", "ABESIJKMHOPCTXYaeopcyxsijhdqwIl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
CYRILLIC["У"] = "Y"
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ꓲ": "I"}
# Punctuation that looks the same.
PUNCTUATION = {"’": "'", "‘": "'", "ʼ": "'", "ʹ": "'", "′": "'", "‛": "'", "‐": "-", "‑": "-", "“": '"', "”": '"', "‟": '"', ";": ";", "｡": "。"}
# Characters without any mark of their own besides the category Cf.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d"


def _tables() -> tuple[dict, dict]:
    """(to one encoding without changing script, the same and look-alike letters to Latin)."""
    plain: dict[int, str | None] = {}
    for cp in (*range(0x3400), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(cp)
        cat = unicodedata.category(c)
        if c.isspace() or cat == "Zs" or cat in ("Zl", "Zp"):
            plain[cp] = " "
        elif cat in ("Cf", "Cc") or c in BLANKS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            plain[cp] = None
        elif 0xFF01 <= cp <= 0xFFEF or 0xFB00 <= cp <= 0xFB06 or 0x1D400 <= cp <= 0x1D7FF or 0x2460 > cp >= 0x2160 or 0xFB13 <= cp <= 0xFB17:
            k = unicodedata.normalize("NFKC", c)
            if k != c:
                plain[cp] = PUNCTUATION.get(k, k)
    plain.update({ord(k): v for k, v in PUNCTUATION.items()})
    look = dict(plain)
    look.update({ord(k): v for t in (CYRILLIC, GREEK, OTHER) for k, v in t.items()})
    for cp, v in plain.items():  # a compatibility form of a look-alike letter
        if v and len(v) == 1 and ord(v) in look and cp not in (ord(v),):
            look[cp] = look[ord(v)]
    return plain, look


PLAIN, LOOK = _tables()
_ODD = "".join(re.escape(chr(c)) for c, v in PLAIN.items() if not 0x20 <= c < 0x7F)
#: A character that has another encoding of the same look, script aside; or a combining mark.
ODD = re.compile(f"[{_ODD}\u0300-\u036f\u3099\u309a]")
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0131\u0251\u0261]")


def look_key(text: str) -> str:
    """A string that is the same for texts that look the same; runs of white space count as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(LOOK))
    else:
        text = text.translate(PLAIN) if not text.isprintable() else text
    return " ".join(text.split(" ")) if "  " not in text and text[:1] != " " != text[-1:] else " ".join(text.split())


def plain_form(text: str) -> str:
    """One encoding for each character, every letter kept in its script."""
    if text.isascii():
        return text.translate(PLAIN) if not text.isprintable() else text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(PLAIN))


_FROM_LATIN = {
    "cyrillic": {ord(v): k for k, v in CYRILLIC.items() if k in "АВЕКМНОРСТХУаеорсухіѕј"},
    "greek": {ord(v): k for k, v in GREEK.items() if k in "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"},
}
_OWN = {
    "cyrillic": re.compile("[" + "".join(chr(c) for c in range(0x400, 0x530) if chr(c) not in CYRILLIC) + "]"),
    "greek": re.compile("[" + "".join(chr(c) for c in range(0x370, 0x400) if chr(c) not in GREEK) + "]"),
    "latin": re.compile("[" + "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isalpha() and chr(c) not in {*CYRILLIC.values(), *GREEK.values()}) + "]"),
}


def _script(s: str) -> str | None:
    got = [(len(r.findall(s)), k) for k, r in _OWN.items()]
    most = max(got)
    return most[1] if most[0] else None


def to_script(word: str, script: str | None) -> str:
    """Look-alike letters brought to one script."""
    word = word.translate(LOOK)
    return word.translate(_FROM_LATIN[script]) if script in _FROM_LATIN else word


_NOT_ALNUM = re.compile(r"[\W_]+")


def compare_words(text: str) -> list[str]:
    """Words for comparing: one form of equal-looking characters, no case, only letters and digits.

    A word takes the script of its own unmistakable letters, else that of the text's, so that upper and lower case of
    a word meet although only one of them has look-alikes.
    """
    if text.isascii():
        text = text.lower()
    else:
        text = plain_form(text)
        if FOREIGN.search(text):
            whole = _script(text)
            text = " ".join(to_script(w, _script(w) or whole) for w in text.split())
        text = unicodedata.normalize("NFC", text.lower().casefold())
    out = []
    for w in text.split():
        if not w.isalnum():
            w = "".join(c for c in w if c.isalnum())
            if not w:
                continue
        out.append(w)
    return out


def is_plain(token: str) -> bool:
    """Whether a token is the only unmistakable spelling of its look: one encoding, one script, and, outside Latin,
    a letter that no Latin letter looks like."""
    if token.isascii():
        return token.isprintable()
    if ODD.search(token) or unicodedata.normalize("NFC", token) != token:
        return False
    if not FOREIGN.search(token):
        return True
    has = {k for k, r in _OWN.items() if r.search(token)}
    if len(has) != 1:
        return False
    (k,) = has
    table = CYRILLIC if k == "cyrillic" else GREEK if k == "greek" else {}
    rest = [c for c in token if c.isalpha() and not _OWN[k].search(c)]
    return all(c in table for c in rest) if k != "latin" else not any(FOREIGN.match(c) for c in token)


def one_script(token: str) -> bool:
    """No mixture of Latin letters with Cyrillic or Greek ones."""
    kinds = {"f" if FOREIGN.match(c) else "l" for c in token if c.isalpha() and ord(c) < 0x530}
    return len(kinds) < 2


_WHITE = "".join(re.escape(chr(c)) for c, v in PLAIN.items() if v == " ")
SPACES = re.compile(f"[{_WHITE}]+")
JAVA_SPACES = "[" + "".join(f"\\x{{{c:x}}}" for c, v in PLAIN.items() if v == " ") + "]+"


def look_spaces(text: str) -> list[str]:
    """The parts between white space of any kind, without empty ones."""
    return [x for x in SPACES.split(text) if x]


def table_form(token: str) -> str:
    """One spelling for all tokens of a look: the script of its unmistakable letters, else Latin."""
    key = look_key(token)
    return unicodedata.normalize("NFC", to_script(key, _script(key)))

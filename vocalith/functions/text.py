"""Text normalizers as column expressions; those that depend on neighbours or on Unicode data are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Marks that transcripts spell out.
PUNCTUATION_TAGS = "<COMMA>|<PERIOD>|<QUESTIONMARK>|<EXCLAMATIONPOINT>"
# Ranges of characters that are written without spaces between words.
CJK_RANGES = r"\x{1100}-\x{11ff}\x{2e80}-\x{a4cf}\x{a840}-\x{d7af}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff65}-\x{ffdc}\x{20000}-\x{2ffff}"
JA_RANGES = r"\x{3041}-\x{309f}\x{30a0}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
# German letters outside ASCII and their spelling in it.
GERMAN = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
# Digits of the eastern Arabic script, and what goes with them.
EASTERN = "٠١٢٣٤٥٦٧٨٩٪_|ڤ"
WESTERN = "0123456789%  ف"


def collapse(c: Column) -> Column:
    """Two or more white-space characters to one space."""
    return F.regexp_replace(c, r"\s{2,}", " ")


def spelled_marks(c: Column, comma: bool = True) -> Column:
    """Without spelled-out punctuation marks; ``comma=False`` keeps ``<COMMA>``."""
    tags = PUNCTUATION_TAGS if comma else PUNCTUATION_TAGS.replace("<COMMA>|", "")
    return collapse(F.regexp_replace(c, tags, ""))


def common_voice(c: Column, lang: Column) -> Column:
    """Language-dependent cleaning; null text stays null, an unknown language is upper-cased only.

    In French the character filter comes before upper-casing with a class of capitals, so small letters vanish: this is
    how results have always been made, and is kept.
    """
    x = F.replace(F.regexp_replace(c, "-+", " "), F.lit("’"), F.lit("'"))
    en = F.upper(F.regexp_replace(x, r"[^A-Za-z\s]", ""))
    fr = F.upper(F.regexp_replace(x, r"[^A-ZÀÂÆÇÉÈÊËÎÏÔŒÙÛÜ' ]", ""))
    pl = F.upper(F.regexp_replace(x, r"[^a-ząćęłńóśźżA-ZĄĆĘŁŃÓŚŹŻ' ]", ""))
    yue = F.translate(F.upper(x), CANTONESE_MARKS, "")
    return F.when(lang == "en", en).when(lang == "fr", fr).when(lang == "pl", pl).when(lang.isin("yue", "zh-HK"), yue).otherwise(F.upper(x))


# Marks that Cantonese transcripts lose.
CANTONESE_MARKS = "\\，。？！?!‘、,.:;「」“”~—ㄧ《》…⋯·﹒．：︰﹖（）－～；￼⠀﹔／ＡＢ–‧"


def wide_to_ascii(c: Column) -> Column:
    """Full-width letters, digits and signs to ASCII, the rest unchanged."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, wide, "".join(chr(x) for x in range(0x21, 0x7F)) + " ")


def remove_punctuation(c: Column) -> Column:
    """Without ASCII punctuation except the apostrophe and the symbol ``<space>``; trimmed and collapsed."""
    x = F.replace(c, F.lit("<space>"), F.lit("\x01"))
    x = F.regexp_replace(x, r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(collapse(F.replace(x, F.lit("\x01"), F.lit("<space>"))))


def german_native(c: Column) -> Column:
    """Lower case, umlauts spelled out, only a-z and white space; collapsed."""
    x = F.lower(c)
    for a, b in GERMAN:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, r"[^a-z\s]", ""), r"\s+", " ")


def alphabetic(c: Column, strict: bool = True) -> Column:
    """Only letters and spaces (strict), or letters, digits and apostrophes too; upper case."""
    return F.upper(F.regexp_replace(c, r"[^A-Za-z ]" if strict else r"[^A-Za-z0-9' ]", ""))


def to_upper_words(c: Column) -> Column:
    """Other characters than ASCII letters, digits and apostrophes to spaces; collapsed, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9']", " "), " +", " ")))


def strip_tags(c: Column) -> Column:
    """Without ``<tags>``, bracketed sounds and unclear marks; upper case, collapsed."""
    x = F.regexp_replace(c, r"<.*?>|\[[^\]]*\]|\{[^}]*\}|\(\(|\)\)", " ")
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def arabic_repeats(c: Column) -> Column:
    """Long repetitions of letters shortened: three of ha, one of alef."""
    return F.regexp_replace(F.regexp_replace(c, "(ه){2,}", "ههه"), "(أ|ا|آ){2,}", "ا")


def arabic_clean(c: Column) -> Column:
    """Punctuation, lone characters, diacritics, script borders, case, dots, digits and repeats, in this order."""
    x = F.regexp_replace(c, r"""[`÷×؛<>()*&^%\]\[ـ،/:"؟.,'{}~¦+|!”…“–]""", "")
    x = F.regexp_replace(x, r"(^|\s)\S(?=\s|$)", "$1")
    x = F.regexp_replace(x, r"[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}]", "")
    x = F.regexp_replace(x, "([A-Za-z]+)", " $1 ")
    x = F.regexp_replace(F.lower(x), r"\s+", " ")
    return F.trim(arabic_repeats(eastern_digits(x)))


def eastern_digits(c: Column) -> Column:
    return F.translate(c, EASTERN, WESTERN)


def cjk_spaced(c: Column) -> Column:
    """Upper case, with spaces around every character of scripts that have none."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), f"([{CJK_RANGES}])", " $1 "), " +", " "))


def ja_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), f"([{JA_RANGES}])", " $1 "), " +", " "))


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK_RANGES}]")


def white_and_marks(c: Column) -> Column:
    """White space collapsed and full-width punctuation mapped for speech synthesis."""
    return F.translate(F.regexp_replace(c, r"\s+", " "), "，。！？；：、‘’“”⁇", ",.!?;:,''\"\"?")


def clock_seconds(c: Column) -> Column:
    """``H:M:S``, ``M:S`` or ``S`` to seconds; null where a part is no number."""
    return F.aggregate(F.split(c, ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))


def char_pairs(c: Column, n: int = 2) -> Column:
    """Groups of n characters with spaces between them."""
    return F.trim(F.regexp_replace(c, f"(.{{{n}}})", "$1 "))


def punctuation_rules(lang: str = "en") -> list[tuple[str, str]]:
    """Spaces and quotes around punctuation by ordered rules; what stands last depends on the language.

    A blank before ``?`` or ``!`` becomes a backslash, and `` cm`` keeps its no-break space as a blank: this is how
    results have always been made. ``\xa0`` below is the no-break space.
    """
    rules = [
        ("\r", ""), (r"\(", " ("), (r"\)", ") "), (" +", " "), (r"\) ([.!:?;,])", ")$1"), (r"\( ", "("), (r" \)", ")"), (r"(\p{Nd}) %", "$1%"), (" :", ":"), (" ;", ";"),
        ("`", "'"), ("''", '"'), ("[„“”]", '"'), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"), ("([a-zA-ZİıſK])[‘]([a-zA-ZİıſK])", "$1'$2"),
        ("([a-zA-ZİıſK])[’]([a-zA-ZİıſK])", "$1'$2"), ("[‘‚]", "'"), ("’", '"'), ("''", '"'), ("´´", '"'), ("…", "..."),
        ("\xa0«\xa0", ' "'), ("«\xa0", '"'), ("«", '"'), ("\xa0»\xa0", '" '), ("\xa0»", '"'), ("»", '"'),
        (" %", "%"), ("nº\xa0", "nº "), ("\xa0:", ":"), ("\xa0ºC", " ºC"), ("\xa0cm", " cm"), ("\xa0([?!])", r"\\$1"), ("\xa0;", ";"), (",\xa0", ", "), ("\xa0+", " "),
    ]
    if lang == "en":
        rules.append(('"([,.]+)', '$1"'))
    elif lang not in ("cs", "cz"):
        rules += [(',"', '",'), (r'(\.+)"(\s*[^<])', '"$1$2')]
    # A digit group: a comma in languages that write decimals so.
    rules.append((r"(\p{Nd}) (\p{Nd})", "$1,$2" if lang in ("de", "es", "cz", "cs", "fr") else "$1.$2"))
    return rules


def punctuation_spacing(c: Column, lang: str = "en") -> Column:
    """A text after all ``punctuation_rules`` of its language."""
    for a, b in punctuation_rules(lang):
        c = F.regexp_replace(c, a, b)
    return c


def separate_punctuation(c: Column) -> Column:
    """Spaces around ``, . ! ? ;`` but single capitals and ordinals keep their dot."""
    x = F.regexp_replace(F.regexp_replace(c, r"([,.!?;])", " $1 "), r"\s+", " ")
    return F.trim(F.regexp_replace(x, r"(?<=^|\s)([A-Z]S|\d+|[A-Z]) \.(?= \S)", "$1."))


@pandas_udf(StringType())
def unicode_basic(s: pd.Series) -> pd.Series:
    """NFKC, invisible characters to spaces, control characters dropped, collapsed; null stays null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t)
        t = re.sub(r"[​-‏‪-‮⁠-⁤﻿]", " ", t)
        t = "".join(x for x in t if unicodedata.category(x)[0] != "C" or x in "\n\t")
        return " ".join(t.split())

    return s.map(one)


def english_basic(c: Column) -> Column:
    """The basic form in lower case with letters, digits, apostrophes and spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unicode_basic(c)), "[^a-z0-9' ]", " "), " +", " "))


@pandas_udf(StringType())
def sentence_case(s: pd.Series) -> pd.Series:
    """A capital for the first letter of the text and after each of ``. ! ?``, where the word is in lower case."""

    def one(t: str | None) -> str | None:
        return t if t is None else re.sub(r"(^\s*|[.!?]\s+)(\w+)", lambda m: m[1] + (m[2].title() if m[2].islower() else m[2]), t)

    return s.map(one)


DIGITS_ZH = "零一二三四五六七八九"


def number_to_zh(n: int) -> str:
    """A cardinal below 10**16 in Chinese."""
    if n == 0:
        return DIGITS_ZH[0]
    out, unit, gap = "", 0, False
    while n:
        n, part = divmod(n, 10000)
        if part:
            s, zero = "", False
            for k, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
                d = part // k % 10
                if d:
                    s += ("零" if zero and s else "") + DIGITS_ZH[d] + name
                    zero = False
                else:
                    zero = True
            out = s + ("", "万", "亿", "万亿")[unit] + ("零" if gap and out else "") + out
            gap = part < 1000
        elif out:
            gap = True
        unit += 1
    return "十" + out[2:] if out.startswith("一十") else out


def zh_to_number(s: str) -> int:
    """The value of a Chinese cardinal."""
    total = section = digit = 0
    for c in s:
        if c in DIGITS_ZH or c in "〇两":
            digit = {"〇": 0, "两": 2}.get(c, DIGITS_ZH.find(c))
        elif c in "十百千":
            section += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
        else:
            section += digit
            if c == "亿":
                total, section = (total + section) * 10**8, 0
            else:
                total += section * 10**4
                section = 0
            digit = 0
    return total + section + digit


def _zh_line(t: str) -> str:
    digits = lambda m: "".join(DIGITS_ZH[int(c)] for c in m if c.isdigit())
    card = lambda x: number_to_zh(int(x)) if len(x) < 16 else digits(x)

    def decimal(x: str) -> str:
        a, _, b = x.partition(".")
        return card(a) + ("点" + digits(b) if b else "")

    t = re.sub(r"(\d{2,4})年", lambda m: digits(m[1]) + "年", t)
    t = re.sub(r"(\d{1,2})月(\d{1,2})([日号])", lambda m: f"{card(m[1])}月{card(m[2])}{m[3]}", t)
    t = re.sub(r"(?<!\d)1\d{10}(?!\d)", lambda m: digits(m[0]), t)
    t = re.sub(r"(\d+)/(\d+)", lambda m: f"{card(m[2])}分之{card(m[1])}", t)
    t = re.sub(r"(\d+(?:\.\d+)?)%", lambda m: "百分之" + decimal(m[1]), t)
    return re.sub(r"\d+(?:\.\d+)?", lambda m: decimal(m[0]), t)


@pandas_udf(StringType())
def zh_spoken(s: pd.Series) -> pd.Series:
    """Dates, phone numbers, fractions, percentages and cardinals of a Chinese text as words."""
    return s.map(lambda t: t if t is None else _zh_line(t))


# Words and phrases in which 儿 is a syllable of its own.
ER_WORDS = (
    "儿女|儿子|儿孙|女儿|儿媳|妻儿|胎儿|婴儿|新生儿|婴幼儿|幼儿|少儿|小儿|儿歌|儿童|儿科|托儿所|孤儿|"
    "儿戏|儿化|台儿庄|鹿儿岛|正儿八经|吊儿郎当|生儿育女|托儿带女|养儿防老|痴儿呆女|"
    "佳儿佳妇|儿怜兽扰|儿无常父|儿不嫌母丑|儿行千里母担忧|儿大不由爷|苏乞儿"
)


def remove_erhua(c: Column) -> Column:
    """The suffix 儿 dropped, except in words where it is a syllable; the word that begins first counts."""
    return F.regexp_replace(c, f"({ER_WORDS})|儿", "$1")


def join_han(c: Column) -> Column:
    """Without white space, but for one blank between ASCII letters, digits and signs on both sides."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"(?<![!-~]) | (?![!-~])", ""), "  +", " ")


def _byte_alphabet() -> dict[int, str]:
    """A character for each byte: printable ASCII stands for itself; the others, in ascending order, take the code points
    from U+0100 on that compatibility normalization leaves as they are."""
    free = (chr(c) for c in range(0x100, 0x250) if unicodedata.normalize("NFKC", chr(c)) == chr(c))
    return {b: chr(b) if 32 <= b <= 126 else next(free) for b in range(256)}


BYTE_TO_CHAR = _byte_alphabet()
#: The mark of an unknown piece, U+2047, reads as a blank.
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()} | {"\u2047": 32}


def bytes_to_text(t: str) -> str:
    """White space runs become one blank; then a character for each UTF-8 byte."""
    return "".join(BYTE_TO_CHAR[b] for b in re.sub(r"\s+", " ", t).encode("utf-8", "surrogatepass"))


def text_from_bytes(t: str) -> str:
    """The inverse; an invalid sequence or a foreign character gives the empty text."""
    try:
        return bytes(CHAR_TO_BYTE[c] for c in t).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return ""


def best_text_from_bytes(t: str) -> str:
    """As ``text_from_bytes``; of an invalid sequence, the most characters that can be kept.

    UTF-8 characters do not overlap, so they are kept from left to right wherever one starts and is whole.
    """
    if whole := text_from_bytes(t):
        return whole
    raw = [CHAR_TO_BYTE.get(c) for c in t]
    out, i = [], 0
    while i < len(raw):
        b = raw[i]
        size = 0 if b is None else 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        part = raw[i : i + size]
        if size and len(part) == size and None not in part:
            try:
                out.append(bytes(part).decode("utf-8"))
                i += size
                continue
            except UnicodeDecodeError:
                pass
        i += 1
    return "".join(out)


_LATIN = "".join(chr(b) for b in range(1, 256))
_BYTES = "".join(BYTE_TO_CHAR[b] for b in range(1, 256))


def byte_encode(c: Column) -> Column:
    """``bytes_to_text`` without leaving the JVM: the bytes read as Latin-1, then a table of 255 characters. A null
    character, which ``translate`` cannot take, has a rule of its own."""
    x = F.decode(F.encode(F.regexp_replace(c, r"(?U)\s+", " "), "UTF-8"), "ISO-8859-1")
    return F.replace(F.translate(x, _LATIN, _BYTES), F.lit("\x00"), F.lit(BYTE_TO_CHAR[0]))


def byte_decode(c: Column) -> Column:
    """``text_from_bytes`` without leaving the JVM."""
    x = F.replace(F.translate(c, _BYTES + "\u2047", _LATIN + " "), F.lit(BYTE_TO_CHAR[0]), F.lit("\x00"))
    own = c.rlike(f"^[{BYTE_TO_CHAR[0]}{re.escape(_BYTES)}\u2047]*$")
    return F.when(own, F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), F.lit(""))).when(c.isNotNull(), "")


@pandas_udf(StringType())
def byte_decode_best(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else best_text_from_bytes(t))

"""Normalizers of conversational and Arabic transcripts, whose rules change case or depend on what stands beside a word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Marks that vanish at first from telephone transcripts in lower case.
PHONE_DROP = r"\[\[skip.*\]\]|\[skip.*\]|\[pause.*\]|\[silence\]|<b_aside>|<e_aside>|_1"
# What is rewritten then, in this order. In the second part ``{n}`` is a group, ``{n^}`` a group in capitals.
PHONE_RULES = (
    (r"\[laughter-(.*?)\]", "{1}"), (r"\[\S+/(\S+)\]", "{1}"), (r"-?\[.*?\](\w+)\[.*?\]-?", "{1}-"), (r"(\w+)\[.*?\]-?", "{1}-"), (r"-?\[.*?\](\w+)-?", "{1}-"),
    (r"\[laugh.*?\]", "[laughter]"), (r"\[sigh.*?\]", "[sigh]"), (r"\[cough.*?\]", "[cough]"), (r"\[mn.*?\]", "[vocalized-noise]"),
    (r"\[breath.*?\]", "[breath]"), (r"\[lipsmack.*?\]", "[lipsmack]"), (r"\[sneeze.*?\]", "[sneeze]"),
    (r"(\w)\.(\w)\.(\w)", "{1^} {2^} {3^}"), (r"(\w)\.(\w)", "{1^} {2^}"), (r"([a-h,j-z])\.", "{1^}"), (r"\._", " "), (r"_(\w)", "{1^}"), (r"(\w)\.s", "{1^}'s"),
    (r"([A-Z])\'s", "{1^}'s"), (r"(\s\w\b|^\w\b)", "{1^}"), (r"'(\S*?)'", "{1}"), (r"\s-\s", " "), (r"\s-\s", " "), (r"(\[.*?\])-", "{1}"), ("-", " "),
)
# What vanishes at the end, and one mark that lost its dash on the way.
PHONE_DROP_LAST = r"\.|,|\?|{|}|~|_\d"
PHONE_LAST = (r"\[vocalized noise\]", "[vocalized-noise]")


def _replacement(to: str):
    parts = re.split(r"\{(\d)(\^?)\}", to)

    def give(m: re.Match) -> str:
        out = parts[0]
        for i in range(1, len(parts), 3):
            g = m[int(parts[i])]
            out += (g.upper() if parts[i + 1] else g) + parts[i + 2]
        return out

    return give


_PHONE = [(re.compile(a), _replacement(b)) for a, b in PHONE_RULES]


def phone_line(t: str) -> str:
    t = re.sub(PHONE_DROP, "", t.lower())
    for rule, give in _PHONE:
        t = rule.sub(give, t)
    t = re.sub(PHONE_LAST[0], PHONE_LAST[1], re.sub(PHONE_DROP_LAST, "", t))
    return " ".join(t.split()).upper()


@pandas_udf(StringType())
def phone_words(s: pd.Series) -> pd.Series:
    """Telephone transcripts in capitals: word fragments, noises and abbreviations in one form; null stays null."""
    return s.map(lambda t: t if t is None else phone_line(t))


# Remarks in brackets that become a blank in evaluation transcripts, after upper-casing, in this order.
REMARKS = (
    "[/BABY CRYING]|[/CHILD]|[[DISTORTED]]|[/DISTORTION]|[[DRAWN OUT]]|[[DRAWN-OUT]]|[[FAINT]]|[SMACK]|[[MUMBLES]]|[[HIGH PITCHED SQUEAKY VOICE]]|"
    "[[PART OF FIRST SYLLABLE OF PREVIOUS WORD CUT OFF]]|[[PREVIOUS WORD SPOKEN WITH A LAUGH]]|[[PREVIOUS TWO WORDS SPOKEN WHILE LAUGHING]]|[[PROLONGED]]|"
    "[/RUNNING WATER]|[[SINGING]]|[/STATIC]|['THIRTIETH' DRAWN OUT]|[/VOICES]|[[WHISPERED]]|[DISTORTION]|[DISTORTION, HIGH VOLUME ON WAVES]|[CHILD'S VOICE]|"
    "[CHILD SCREAMS]|[CHILD VOICE]|[CHILD YELLING]|[CHILD SCREAMING]|[CHILD'S VOICE IN BACKGROUND]|[CHANNEL NOISE]|[CHANNEL ECHO]|[ECHO FROM OTHER CHANNEL]|"
    "[ECHO OF OTHER CHANNEL]|[CLICK]|[DISTORTED]|[BABY CRYING]|[METALLIC KNOCKING SOUND]|[METALLIC SOUND]|[PHONE JIGGLING]|[BACKGROUND SOUND]|[BACKGROUND VOICE]|"
    "[BACKGROUND VOICES]|[BACKGROUND NOISE]|[CAR HORNS IN BACKGROUND]|[CAR HORNS]|[CARNATING]|[CRYING CHILD]|[CHOPPING SOUND]|[BANGING]|[CLICKING NOISE]|[CLATTERING]|"
    "[ECHO]|[KNOCK]|[RIGHT]|[SOUND]|[SQUEAK]|[STATIC]|[[SAYS WITH HIGH-PITCHED SCREAMING LAUGHTER]]|[VOICES]|[WATER RUNNING]|[SOUND OF TWISTING PHONE CORD]|"
    "[SOUND OF SOMETHING FALLING]|[NOISE OF MOVING PHONE]|[SOUND OF RUNNING WATER]|[CHANNEL]|[SILENCE]|{BREATH}|{BREATHY}|{CHANNEL NOISE}|{CLEAR THROAT}|{CLEARING THROAT}|"
    "{CLEARS THROAT}|{COUGH}|{DRAWN OUT}|{EXHALATION}|{EXHALE}|{GASP}|{HIGH SQUEAL}|{INHALE}|{LIPSMACK}|{NOISE OF DISGUST}|{SIGH}|{SNIFF}|{SNORT}|{SHARP EXHALATION}|{BREATH LAUGH}"
).split("|")
# Remarks of laughter and noise, which become blanks as well; fragments that stand for words.
LAUGHS = "[[IN THE LAUGH]]|[[LAST WORD SPOKEN WITH A LAUGH]]|[[SAYS LAUGHING]]|[[SPOKEN WHILE LAUGHING]]|[BACKGROUND LAUGHTER]|[NOISE-GOOD]|[MN]|{LAUGH}|[LAUGHTER]|[NOISE]|[VOCALIZED-NOISE]".split("|")
FRAGMENTS = {"[UH]": "UH", "-[W]HERE": "WHERE", "Y[OU]I-": "YOU I", "-[A]ND": "AND", "JU[ST]": "JUST"}
# Signs that become a blank, and two marks of segments.
SIGNS = ("--", "//", *".?~,;()&%*{}")
SEGMENT_MARKS = ("IGNORE_TIME_SEGMENT_IN_SCORING", "IGNORE_TIME_SEGMENT_SCORING")


def exam_line(t: str) -> str:
    """An evaluation transcript in capitals: what stands in angle brackets goes wherever it stands, then remarks, signs and
    blanks. A contraction keeps its spoken form: ``<contraction e_form="[a=>b]">`` goes as a whole."""
    if "contraction e_form" in t:
        for form in re.findall(r'<contraction e_form(.*?)">', t):
            t = t.replace(form, " ")
        t = t.replace("<contraction e_form", " ").replace('">', " ")
    t = t.upper()
    for tag in re.findall(r"<(.*?)>", t):
        t = t.replace(tag, " ")
    t = t.replace("<", " ").replace(">", " ")
    for x in (*REMARKS, *LAUGHS):
        t = t.replace(x, " ")
    for a, b in FRAGMENTS.items():
        t = t.replace(a, b)
    for x in ("-", *SIGNS, *SEGMENT_MARKS):
        t = t.replace(x, " ")
    return " ".join(t.split())


@pandas_udf(StringType())
def exam_words(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else exam_line(t))


def map_acronyms(line: str, table: dict[str, str]) -> str:
    """A line whose first word is an id: a capital ``I`` counts as a letter of an acronym only beside other single capitals;
    all other keys are mapped wherever they stand. The words come out in lower case."""
    head, *words = line.split() or [""]
    single = [len(w) == 1 and "A" <= w <= "Z" for w in words]
    out = []
    for i, w in enumerate(words):
        if w in ("I", "i"):
            beside = (i > 0 and single[i - 1]) or (i + 1 < len(words) and single[i + 1])
            out.append(table[w] if w == "I" and beside and w in table else w)
        else:
            out.append(table.get(w, w))
    return f"{head} {' '.join(out).lower()}" if words else f"{head} "


def acronym_entries(word: str, pron: str, letters: dict[str, str]) -> tuple[str, str, str] | None:
    """(dotted form, spaced form, kind) of a word that is read letter by letter, also with a plural or possessive s; else null."""
    if not re.fullmatch(r"[A-Za-z]+('s)?", word):
        return None
    for tail, kind in (("'s", "'s"), ("s", "s")):
        if word.endswith(tail) and pron[-1:] in ("s", "z"):
            base, said = word[: -len(tail)], pron[:-2]
            break
    else:
        if "'" in word or word.endswith("s"):
            return None
        base, said, kind = word, pron, ""
    if not base or any(c.upper() not in letters for c in base) or " ".join(letters[c.upper()] for c in base) != said:
        return None
    low = base.lower()
    return "._".join(low) + "." + kind, " ".join(low) + ("'s" if kind else ""), kind


# Marks and signs that Mandarin meeting transcripts lose, and full-width letters that become plain ones.
HAN_MARKS = "<sil> <%> <-> <$> <#> <_> <space>".split()
HAN_SIGNS = "`&,，丶。、？·*！$+-\\?￥%.<＆"
HAN_LETTERS = {"ａ": "A", "ｂ": "B", "ｃ": "C", "ｋ": "K", "ｔ": "T"}
# More of both in mixed Mandarin and English lessons.
MIXED_SIGNS = "`'&,，丶。、？·*！$+-\\?￥%.<＆~=:!/‘’“”[]@#：；…《》"
MIXED_LETTERS = {c: chr(ord(c) - 0xFEE0) for c in "ＡＣＤＥＧＨＩＮＵＷＹ"} | HAN_LETTERS


def _without(c: Column, marks: list[str], signs: str, letters: dict[str, str]) -> Column:
    for m in marks:
        c = F.replace(c, F.lit(m), F.lit(""))
    return F.upper(F.translate(c, "".join(letters) + signs, "".join(letters.values())))


def han_meeting(c: Column) -> Column:
    """Mandarin meetings: no blanks, marks or signs; a full-width capital A goes, some small letters become capitals."""
    return _without(F.replace(F.trim(c), F.lit(" "), F.lit("")), HAN_MARKS, HAN_SIGNS + "Ａ", HAN_LETTERS)


def han_mixed(c: Column) -> Column:
    """Lessons in Mandarin and English: blanks stay, marks and signs go."""
    return _without(F.trim(c), HAN_MARKS, MIXED_SIGNS, MIXED_LETTERS)


# A transliteration of Arabic letters into ASCII, letter by letter.
BUCKWALTER = "|&}btjGx*z$DZg_qlnwyNaio`PJ'><VApvHdrsSTEfkmhYFKu~{"
ARABIC = "آؤئبتجگخذزشضظغـقلنويٌَِْٰپچءأإڤاةثحدرسصطعفكمهىًٍُّٱ"
# Signs besides ASCII punctuation that Arabic transcripts lose, and letters whose repetitions are shortened.
ARABIC_SIGNS = "﴿﴾‘`÷×؛<>_()*&^][ـ،/:\"؟,'{}~¦+|!”…“–"
ARABIC_REPEATS = (("ه", "ههه"), ("أ", "ا"), ("ا", "ا"), ("آ", "ا"), ("ص", "ص"), ("و", "و"))


def from_buckwalter(c: Column) -> Column:
    """ASCII transliteration to Arabic letters; other characters stay."""
    return F.translate(c, BUCKWALTER, ARABIC)


def to_buckwalter(c: Column) -> Column:
    return F.translate(c, ARABIC, BUCKWALTER)


def arabic_repeats(c: Column) -> Column:
    for a, b in ARABIC_REPEATS:
        c = F.regexp_replace(c, f"(?:{a}){{2,}}", b)
    return c


def arabic_chain(c: Column) -> Column:
    """Cleaning of Arabic transcripts in order: signs, lone characters, diacritics, borders to Latin words, case and blanks,
    eastern digits, borders to numbers, repeated letters. Numbers stay digits: spelling them needs a library."""
    ascii_signs = "".join(x for x in r"""!"#$&'()*+,-/:;<=>?[\]^_`{|}~""")
    c = F.translate(c, "".join(dict.fromkeys(ARABIC_SIGNS + ascii_signs)), "")
    c = F.regexp_replace(c, r"(?U)\s+\.", "")
    words = F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda w: (F.length(w) > 1) | w.rlike(r"^\p{N}$"))
    c = F.array_join(words, " ")
    c = F.regexp_replace(c, r"[\x{064B}-\x{0652}\x{06D4}\x{0670}\x{0674}\x{06D5}-\x{06ED}]+", "")
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "([a-z]+)", " $1 "), r"(?U)\s+", " ")
    c = F.regexp_replace(c, r"\s+\.\s+", ".")
    c = F.translate(F.trim(c), "٠١٢٣٤٥٦٧٨٩٪_|ڤ", "0123456789%  ف")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "([0-9][0-9.]*)", " $1 "), r"\s+", " "))
    return arabic_repeats(c)

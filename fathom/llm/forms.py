"""One consistent form of text: confusables skeleton, and the disguises that it undoes (problem 5).

``skeleton`` decomposes, replaces every character by its prototype and decomposes
again; texts that look alike have equal skeletons.  The prototypes of all characters are one table
(``prototypes``): spaces, invisible characters, compatibility forms and radicals by rule, look-alike letters by script.
The box holds no copy of the public table of confusables; ``more_prototypes`` reads one in its format.

A skeleton also changes what is ordinary, so a place where it changes a text (``changes``) is judged: whether a text
is disguised, and its readable form (``consistent``), come from the changes that are no ordinary
use (Chinese punctuation, circled numbers, superscripts, emoji joiners, Greek symbols, words of other scripts).

Null stays null, empty stays empty; both functions read whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they look like.
CYRILLIC_LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝӏАВЕЗКМНОРСТУХІЅЈҮԌԚԜ", "aeopcyxisjhdqwlABE3KMHOPCTYXISJYGQW"))
GREEK_LOOKALIKES = dict(zip("ονριυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpiuABEZHIKMNOPTYX"))
OTHER_LOOKALIKES = dict(zip("օոսհցզյՕՍՏ" "ⲟⲣⲥⲞⲢⲤⲀⲂⲈⲎⲒⲔⲘⲚⲦⲬ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "onuhgqjOUS" "opcOPCABEHIKMNTX" "DRTAJEWMHGZbRWSVSLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU"))
# Latin letters of other languages and notations that look like plain ones in the skeleton.
LATIN_LOOKALIKES = dict(zip("ıɑɡɩᴄᴏᴠᴡᴢꜱ", "iagicovwzs"))
# Greek letters that look like Latin ones in the skeleton, but are symbols in ordinary text.
GREEK_SYMBOLS = dict(zip("αγκστχ", "aykotx"))
# ASCII characters that look like others.
ASCII_LOOKALIKES = {"I": "l", "1": "l", "|": "l", "0": "O", "m": "rn"}
# Radicals that Unicode gives no decomposition for.
RADICALS = dict(zip("⺁⺇⺒⺝⺟⺠⺩⺷⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳", "厂几巳月母民王羊虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟"))

_SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0e\ufeff\uffa0\U000e0001-\U000e007f\U000e0100-\U000e01ef"
_EMOJI = "©®‼⁉™ℹ←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
_JOINER = f"(?<![{_EMOJI}\ufe0f])\u200d|\u200d(?![{_EMOJI}])|(?<![{_EMOJI}0-9#*])\ufe0f"
_RADICAL = "\u2e80-\u2fdf豈-\ufaff\U0002f800-\U0002fa1f"
_LIGATURE = "ﬀ-ﬆ"
_WIDE = "０-９Ａ-Ｚａ-ｚ"
_GONE = re.compile(f"[{_INVISIBLE}]|{_JOINER}")
_LETTERS = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES | OTHER_LOOKALIKES
_LIKE = "".join(_LETTERS)
_WORD = re.compile("[A-Za-zÀ-ɏ\u0300-\u036fͰ-ϿЀ-ԯԱ-ևᎠ-ᏽⲀ-ⳳꓐ-ꓽḀ-ỿ]+")
_HAS_LIKE = re.compile(f"[{_LIKE}]")
_LATIN = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")
_CYRILLIC_OWN = re.compile(f"(?![{_LIKE}])[Ѐ-ԯ]")
_PROTOTYPE = {ord(k): v for k, v in _LETTERS.items()}


def _spread(signs: str) -> list[str]:
    """The characters of a class like ``a-cx``."""
    return [chr(c) for m in re.finditer("(.)-(.)|(.)", signs, re.S) for c in (range(ord(m[1]), ord(m[2]) + 1) if m[1] else [ord(m[3])])]


@lru_cache(1)
def prototypes() -> dict[str, str]:
    """Character → prototype, of every character that has another one."""
    table = {c: " " for c in _spread(_SPACES)} | {c: "" for c in _spread(_INVISIBLE)}
    fonts = [chr(c) for a, b in ((0x1D400, 0x1D7FF), (0x2100, 0x214F), (0xFF00, 0xFFEF)) for c in range(a, b + 1)]
    for c in _spread(_RADICAL) + _spread(_LIGATURE) + fonts:
        if (plain := unicodedata.normalize("NFKD", c)) != c:
            table[c] = plain
    return table | RADICALS | _LETTERS | LATIN_LOOKALIKES | GREEK_SYMBOLS | ASCII_LOOKALIKES


def more_prototypes(lines: Iterable[str]) -> dict[str, str]:
    """Character → prototype from lines of the public table of confusables (``source ; target ; ...`` in hexadecimal)."""
    parts = [line.split(";") for line in lines if ";" in line and not line.lstrip("\ufeff").startswith("#")]
    return {chr(int(p[0], 16)): "".join(chr(int(x, 16)) for x in p[1].split()) for p in parts if len(p[0].split()) == 1}


# Kinds of changes that no ordinary text has; letters count by their word, joiners and selectors by their neighbours.
_TABLE = {ord(c): p for c, p in prototypes().items() if c in RADICALS or re.match(f"[{_SPACES}{_RADICAL}{_LIGATURE}{_WIDE}]", c)}
_CHANGED = re.compile(f"[{_SPACES}{_INVISIBLE}{_RADICAL}{_LIGATURE}{_WIDE}\u0300-\u036f\u200d\ufe0f{_LIKE}]")


def changes(text: str) -> Iterator[tuple[int, int]]:
    """Places (start, end) where the skeleton changes the text and that is no ordinary use."""
    own = None
    for m in _CHANGED.finditer(text):
        c = m.group()
        if c in _LETTERS:
            own = {k for w in _words(text, bool(_CYRILLIC_OWN.search(text))) for k in range(*w.span())} if own is None else own
            if m.start() in own:
                yield m.span()
        elif "\u0300" <= c <= "\u036f":
            if m.start() and text[m.start() - 1].isalpha():  # an accent after its letter
                yield m.span()
        elif ord(c) in _TABLE or _GONE.match(text, m.start()):
            yield m.span()


def _words(text: str, own: bool):
    """Words of look-alikes: mixed with Latin, or look-alike throughout where no real word of that script stands."""
    for m in _WORD.finditer(text):
        w = m.group()
        if not _HAS_LIKE.search(w):
            continue
        if _LATIN.search(w):
            yield m
        elif not own and all(c in CYRILLIC_LOOKALIKES for c in w):
            yield m
        elif len(w) > 1 and all(c in GREEK_LOOKALIKES for c in w):
            yield m


def disguised(text: str | None) -> bool:
    """Whether the text holds other characters than it seems to."""
    return bool(text) and not text.isascii() and any(True for _ in changes(text))


def consistent(text: str | None) -> str | None:
    """The text in its one consistent form; equal-looking texts become equal: prototypes in place of the changes, accents composed."""
    if not text or text.isascii():
        return text
    parts, at = [], 0
    for a, b in changes(text):
        c = text[a:b]
        parts += [text[at:a], c if "\u0300" <= c <= "\u036f" else "" if _GONE.match(text, a) else unicodedata.normalize("NFKC", prototypes()[c])]
        at = b
    if not parts:
        return text
    text = unicodedata.normalize("NFC", "".join(parts) + text[at:])
    if _HAS_LIKE.search(text):  # a word may have become one of look-alikes once its signs are gone
        again = {a for a, _ in changes(text) if text[a] in _LETTERS}
        text = "".join(_LETTERS[c] if i in again else c for i, c in enumerate(text)) if again else text
    return text


def skeleton(text: str | None, more: dict[str, str] | None = None) -> str | None:
    """Decompose, replace each character by its prototype, decompose again; ``more`` are further prototypes."""
    if not text:
        return text
    table = str.maketrans(prototypes() | more) if more else _skeleton_table()
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", _GONE.sub("", text)).translate(table))


@lru_cache(1)
def _skeleton_table() -> dict[int, str]:
    return str.maketrans(prototypes())


@F.pandas_udf(T.BooleanType())
def _disguised(text: pd.Series) -> pd.Series:
    return text.map(disguised).astype(bool)


@F.pandas_udf(T.StringType())
def _consistent(text: pd.Series) -> pd.Series:
    return text.map(consistent)


@F.pandas_udf(T.StringType())
def _skeleton(text: pd.Series) -> pd.Series:
    return text.map(skeleton)


#: Only texts with a character outside ASCII and outside plain Han text go to Python.
_ODD = r"[^\x00-\x7F\x{4E00}-\x{9FFF}\x{3001}-\x{3011}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF1F}\x{2018}-\x{201D}]"


def odd(text: Column) -> Column:
    return F.coalesce(text.rlike(_ODD), F.lit(False))


def consistent_text(text: Column) -> Column:
    return F.when(odd(text), _consistent(text)).otherwise(text)


def is_disguised(text: Column) -> Column:
    return F.when(odd(text), _disguised(text)).otherwise(F.lit(False))


def skeleton_text(text: Column) -> Column:
    return _skeleton(text)


def letters_digits(text: Column) -> Column:
    """Every letter and number of any script, lower-cased; all else dropped."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def unify(df: DataFrame, text: str, form: str = "form", flag: str = "is_disguised") -> DataFrame:
    """``df`` with the consistent form of column ``text`` and whether it was disguised.

    Null texts keep a null form and are not disguised; repeated rows stay repeated;
    other columns pass through (a column named like an output is replaced).
    """
    return df.withColumn(flag, is_disguised(F.col(text))).withColumn(form, consistent_text(F.col(text)))


def look_alike_groups(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Rows (``key``, group, group_size, n_forms): originals grouped by equal skeleton.

    The group id is the hash of the skeleton; sizes come from partial aggregation and a
    join on the hash of rows that are not alone, so no group is gathered in one task.
    Null texts form no group and are left out.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"))
    rows = rows.select(*keys, F.sha2(skeleton_text(F.col("_t")), 256).substr(1, 32).alias("skeleton_hash"), F.xxhash64("_t").alias("_form"))
    forms = rows.groupBy("skeleton_hash", "_form").agg(F.count("*").alias("_n"))
    sizes = forms.groupBy("skeleton_hash").agg(F.sum("_n").alias("group_size"), F.count("*").alias("n_forms"))
    return rows.drop("_form").join(sizes, "skeleton_hash")

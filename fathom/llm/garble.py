"""Garbled text from wrong character encodings (problem 2): detection and repair.

The byte forms of a repertoire of characters are decoded with every other encoding
beforehand; an Aho-Corasick automaton over all these sequences finds garbled spans in
one pass, and only the runs around matched spans are replaced, by the pair that explains
most.  Where one garbled character is one character again (letters of Western code pages,
GBK read as another double-byte code), the images of all characters are listed beforehand
too; there single characters are no proof, so a letter is replaced only in a place where it can't stand
itself, and a stretch of Han characters only by the sum of its scores.  UTF-8 read as a double-byte code depends on
the neighbours and is matched on the bytes of a suspicious run.  Runs that are ordinary Japanese, Korean or
traditional Chinese are left alone.

Rounds go on while something is replaced, for text garbled repeatedly.  Null and empty texts are never garbled; whole
texts are read; work is per row, so the operator neither shuffles nor gathers anything.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings that text was read in by mistake.
SINGLE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_15", "cp1254", "cp1253"]
DOUBLE = ["gbk", "big5", "cp932", "cp949", "euc_jp"]
WESTERN = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"]
# Letters outside ASCII of the Western languages handled.
LETTERS = "äöüßÄÖÜéèêëàâçîïôùûœæñÉÈÊÀÂÇÎÔÛ"
_CYR_LIKE = set("аеорсухіѕјһԁԛԝӏАВЕЗКМНОРСТУХІЅЈ")
# Accented letters of other Western languages, which stand in foreign words; words of one letter.
FOREIGN, ALONE = "íóáúìòýëÏÌÍÙ", "àÀ"
# The most frequent syllables of Korean.
SYLLABLES = frozenset("이다는을를의가에하고은로도한지서자기사대나시어니습")


def _decode(raw: bytes, enc: str) -> str | None:
    try:
        return raw.decode(enc)
    except UnicodeDecodeError:
        if enc in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):  # undefined bytes pass through, as browsers have it
            out = "".join(bytes([b]).decode(enc, "ignore") or chr(b) for b in raw)
            return out
        return None


def _hanzi() -> list[str]:
    """The Han characters of GB 2312, by its row and cell rule."""
    return [bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xF8) for b in range(0xA1, 0xFF)]


@lru_cache(1)
def _common() -> frozenset[str]:
    """First-level Han characters and Chinese punctuation."""
    han = {bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)}
    return frozenset(han | set("，。：；、（）“”‘’！？《》【】—…％～·±×℃") - {""})


@lru_cache(1)
def _known() -> frozenset[str]:
    return frozenset(c for c in _hanzi() if c) | _common()


@lru_cache(1)
def automaton():
    """Sequences of all encoding pairs; a value lists (pair, original)."""
    import ahocorasick

    table: dict[str, list[tuple[str, str]]] = {}

    def add(seq: str | None, pair: str, original: str) -> None:
        if seq and seq != original and not seq.isascii():
            table.setdefault(seq, []).append((pair, original))

    blocks = [(0x80, 0x17F), (0x391, 0x3C9), (0x2010, 0x2044), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x2460, 0x2473), (0x2260, 0x2265), (0x3000, 0x301F), (0xFF01, 0xFF5E)]
    signs = [chr(c) for a, b in blocks for c in range(a, b + 1)]
    han = [c for c in _hanzi() if c]
    for c in signs + han:
        for enc in SINGLE:
            add(_decode(c.encode(), enc), f"utf-8>{enc}", c)
    gbk = [bytes([a, b]) for a in (0xA1, 0xA3) for b in range(0xA1, 0xFF)] + [c.encode("gbk") for c in han]
    for raw in gbk:
        c = raw.decode("gbk", "ignore")
        for enc in WESTERN:
            seq = _decode(raw, enc)
            add(seq if seq and len(seq) == 2 else None, f"gbk>{enc}", c)
    for enc in SINGLE:  # emoji and other signs of four bytes
        seq = _decode(b"\xf0\x9f", enc)
        add(seq, f"utf-8>{enc}", "")
    found = ahocorasick.Automaton()
    for seq, values in table.items():
        found.add_word(seq, (len(seq), tuple(values)))
    found.make_automaton()
    return found


@lru_cache(None)
def _bytes_of(enc: str) -> tuple[dict[int, str], re.Pattern]:
    """Characters of the upper half of ``enc`` → byte (as a Latin-1 character), and the pattern of their runs."""
    table = {ord(_decode(bytes([b]), enc) or chr(b)): chr(b) for b in range(0x80, 0x100)}
    return table, re.compile("[" + "".join(map(re.escape, map(chr, table))) + "]+")


_UTF8_CHAR = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}")


def _undo(text: str, pair: str, spans: list[tuple[int, int]]) -> str:
    """Replaces the matched spans, and what the pair can have garbled in one run with them; all else stays."""
    true, _, enc = pair.partition(">")
    table, runs = _bytes_of(enc)

    def utf8(m: re.Match) -> str:
        raw, out, at = m.group().translate(table).encode("latin-1"), [], 0
        for x in _UTF8_CHAR.finditer(raw):
            try:
                new = x.group().decode()
            except UnicodeDecodeError:
                continue
            out += [m.group()[at : x.start()], new]
            at = x.end()
        return "".join(out) + m.group()[at:]

    def gbk(m: re.Match) -> str:
        run = m.group()
        raw = run.translate(table).encode("latin-1")
        best = run
        for skip in (0, 1):
            body = raw[skip : len(raw) - (len(raw) - skip) % 2]
            new = body.decode("gbk", "replace")
            if len(body) > 1 and all(c in _known() for c in new):
                return run[:skip] + new + run[skip + len(body) :]
        return best

    one, starts = utf8 if true == "utf-8" else gbk, sorted(a for a, _ in spans)

    def matched(m: re.Match) -> str:
        i = bisect_left(starts, m.start())
        return one(m) if i < len(starts) and starts[i] < m.end() else m.group()

    return runs.sub(matched, text)


_HALF = re.compile("[\x80-\xad\xaf\xb3-\u02ff\u0391-\u03ff\u0402-\u04ff\u2020-\u25ff]|[\x80-\xff\u2010-\u201d]{2}")


def _by_sequences(text: str) -> str | None:
    """The text with its matched spans replaced, or None where nothing is garbled."""
    utf, gb, cover = {}, {}, {}
    if not _HALF.search(text):
        return None
    for end, (n, values) in automaton().iter(text):
        start = end - n + 1
        if all(c in _CYR_LIKE or c.isascii() for c in text[start : end + 1]):
            continue
        for pair, _ in values:
            (utf if pair[0] == "u" else gb).setdefault(pair, []).append((start, end + 1))
    for pair, spans in utf.items():
        cover[pair] = sum(b - a for a, b in spans)
    for pair, spans in gb.items():  # two letters alone are no proof: four garbled letters must follow each other
        linked = {x for x, y in zip(spans, spans[1:]) if y[0] <= x[1]} if len(spans) > 1 else ()
        ends = {a for a, _ in spans}
        if any(b in ends for _, b in spans):
            cover[pair] = len(linked) - 0.5
    for best in sorted(cover, key=cover.get, reverse=True):
        new = _undo(text, best, (utf if best in utf else gb)[best])
        if new != text:
            return new
    return None


_RUN = re.compile("[^\x00-\x7f]+")
_HAN = re.compile("[㐀-鿿]")
_UTF8 = re.compile(rb"(?:[\xc3\xce\xcf][\x80-\xbf]|[\xe2-\xe9\xef][\x80-\xbf]{2}){2,}")


@lru_cache(1)
def _suspicious() -> re.Pattern:
    """Han characters outside GB 2312, kana, bopomofo, hangul, half-width forms, private signs."""
    known, ranges, start = _known(), [], None
    for c in range(0x4E00, 0xA001):
        rare = c < 0xA000 and chr(c) not in known
        if rare and start is None:
            start = c
        elif not rare and start is not None:
            ranges.append(f"{chr(start)}-{chr(c - 1)}" if c - 1 > start else chr(start))
            start = None
    # Extension A, kana to bopomofo, hangul, half-width forms, small and vertical forms, private signs
    other = [(0x3400, 0x4DBF), (0x3041, 0x31BF), (0xAC00, 0xD7AF), (0xFF61, 0xFF9F), (0xFE30, 0xFE6B), (0x2474, 0x24FF), (0xE000, 0xF8FF)]
    return re.compile("[" + "".join(ranges) + "".join(f"{chr(a)}-{chr(b)}" for a, b in other) + "]")


def _utf8_as(run: str, enc: str) -> str | None:
    """A run in which stretches are UTF-8 read as a double-byte encoding."""
    if not _UTF8.search(run.encode(enc, "replace")):
        return None
    raw, sizes = bytearray(), []
    for c in run:
        b = c.encode(enc, "replace")
        raw += b
        sizes.append(len(b))
    edges, at = [0], 0
    for n in sizes:
        at += n
        edges.append(at)
    place = {e: i for i, e in enumerate(edges)}
    parts, done = [], 0
    for m in _UTF8.finditer(bytes(raw)):
        a, b = m.span()
        while a not in place:
            a += 1
        new = bytes(raw[m.start() : b]).decode()
        if sum(c in _known() for c in new) < 0.8 * len(new) and "\ufffd" not in new:
            continue
        while b not in place:
            b += 1
        if m.start() not in place:  # the first character belongs to a stretch cut off before
            a = max(e for e in place if e <= m.start())
        if place[a] < done:
            continue
        old = run[place[a] : place[b]]
        if not _suspicious().search(old) and sum(c in _common() for c in old) > 0.6 * len(old):
            continue
        parts += [run[done : place[a]], new]
        done = place[b]
    return "".join(parts) + run[done:] if parts else None


@lru_cache(None)
def _double_images(enc: str) -> dict[str, tuple[str, float]]:
    """Of each character that GBK read as ``enc`` can give: the original, and how much likelier it is."""
    known, common, out = _known(), _common(), {}
    for a in range(0xA1, 0xF8):
        for b in range(0xA1, 0xFF):
            try:
                r, c = bytes([a, b]).decode("gb2312"), bytes([a, b]).decode(enc)
            except UnicodeError:
                continue
            if len(c) == 1:
                gain = 1.0 if r in common else -0.7 if r in known else -4.0
                out[c] = r, gain + (-1.5 if c in common else 0.7 if c in known else 2.0 if _HAN.match(c) else 5.0)
    return out


def _gbk_as(run: str, enc: str) -> str | None:
    """A run in which one stretch is GBK read as another double-byte encoding: the stretch of the best sum of scores."""
    known, common, images = _known(), _common(), _double_images(enc)
    best, span, total, start = 0.0, None, 0.0, 0
    for i, c in enumerate(run):
        if total <= 0:
            total, start = 0.0, i
        total += images[c][1] if c in images else -6.0
        if total > best:
            best, span = total, (start, i + 1)
    if span is None or best < 5.5 or span[1] - span[0] < 3:
        return None
    a, b = span
    if best < 7 and 2 * sum(c in common for c in run[a:b]) >= b - a:
        return None
    odd = sum(1 if _HAN.match(c) else 2 for c in run[a:b] if c not in known)
    return run[:a] + "".join(images[c][0] if c in images else c for c in run[a:b]) + run[b:] if odd >= (2 if best >= 7 else 1) else None


_KANA, _HANGUL = re.compile("[\u3041-\u309f]"), re.compile("[\uac00-\ud7a3]")
# Signs that Chinese punctuation becomes in Big5: bopomofo and small forms.
_BIG5_SIGNS = re.compile("[\u3105-\u3129\ufe50-\ufe6b]")


def _is_other_script(text: str) -> bool:
    """Ordinary Japanese (hiragana throughout), Korean (frequent syllables, hardly a Han character) or traditional Chinese (first
    level of Big5 and ordinary punctuation); never a text with characters of simplified Chinese alone."""
    han, hangul, kana = _HAN.findall(text), _HANGUL.findall(text), _KANA.findall(text)
    if sum(c in _simplified() for c in han) >= 2 or _BIG5_SIGNS.search(text):
        return False
    if len(set(kana)) >= 2 and len(kana) >= 0.15 * (len(han) + len(kana)):
        return True
    if hangul:
        return len(han) <= 0.1 * len(hangul) and sum(c in SYLLABLES for c in hangul) >= 0.12 * len(hangul)
    return bool(han) and sum(c in _first_of_big5() for c in han) >= 0.95 * len(han)


@lru_cache(1)
def _simplified() -> frozenset[str]:
    """First-level characters that neither Big5 nor the Japanese and Korean standards have."""

    def foreign(c: str) -> bool:
        for enc in ("big5", "euc_jp", "cp949"):
            try:
                c.encode(enc)
                return True
            except UnicodeError:
                pass
        return False

    return frozenset(c for c in _common() if _HAN.match(c) and not foreign(c))


@lru_cache(1)
def _first_of_big5() -> frozenset[str]:
    return frozenset(bytes([a, b]).decode("big5", "ignore") for a in range(0xA4, 0xC7) for b in [*range(0x40, 0x7F), *range(0xA1, 0xFF)]) - {""}


_FOREIGN = re.compile("[\u3400-\u9fff\uac00-\ud7af\uff61-\uff9f]+[A-Za-z]?")
_WESTERN_SIGN = re.compile("[\u00a1-\u017f\u0391-\u03c9\u2010-\u2044\u20ac\u2122A-Za-z]+")


def _mostly_latin(text: str) -> bool:
    """A text of few characters outside ASCII."""
    return len(text.encode("utf-8", "replace")) < 1.5 * len(text)


def _western_as(text: str) -> str | None:
    """A Western text in which letters outside ASCII, in UTF-8, were read as a double-byte encoding."""
    changed = False

    def undo(m: re.Match) -> str:
        nonlocal changed
        for enc in DOUBLE:
            for run in (m.group(), m.group().rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")):
                try:
                    new = run.encode(enc).decode()
                except UnicodeError:
                    continue
                if not new.isascii() and _WESTERN_SIGN.fullmatch(new):
                    changed = True
                    return new + m.group()[len(run) :]
        return m.group()

    new = _FOREIGN.sub(undo, text)
    return new if changed else None


def _by_bytes(text: str) -> str | None:
    if _mostly_latin(text) and (new := _western_as(text)) is not None:
        return new
    if not _suspicious().search(text) or _is_other_script(text):
        return None
    changed, parts, at = False, [], 0
    for m in _RUN.finditer(text):
        run = m.group()
        odd = set(_suspicious().findall(run)) if len(run) > 2 else ()
        if len(odd) < 2 and not any(not _HAN.match(c) for c in odd):  # one rare character may be a name
            continue
        options = [new for enc in DOUBLE if (new := _utf8_as(run, enc))]
        options += [new for enc in DOUBLE[1:] if (new := _gbk_as(run, enc))]
        if options:
            worst = [len(_suspicious().findall(x)) + x.count("\ufffd") for x in options]
            parts += [text[at : m.start()], options[worst.index(min(worst))]]
            at, changed = m.end(), True
    return "".join(parts) + text[at:] if changed else None


@lru_cache(1)
def _images() -> dict[str, dict[str, str]]:
    """Of each pair of Western encodings: image of a letter → letter."""
    pairs: dict[str, dict[str, str]] = {}
    for true in WESTERN:
        for wrong in [*WESTERN, "cp1251", "cp1250"]:
            if wrong == true or {true, wrong} == {"cp1252", "latin-1"}:
                continue
            for c in LETTERS:
                try:
                    x = _decode(c.encode(true), wrong)
                except UnicodeEncodeError:
                    continue
                if x and len(x) == 1 and x != c and not x.isascii() and x not in _NEVER:
                    pairs.setdefault(f"{true}>{wrong}", {})[x] = c
    return pairs


# Signs that stand next to letters in ordinary text, and letters of foreign words.
_NEVER = set("µãÃåÅøØñÑﬁﬂ®™©²°·’‘“”–—…«»") | _CYR_LIKE
_INNER = set("³¹´`¸×÷±§¶¡¿ªº¢£¥¤¦¬¯¨ˆ˜‰‹›†‡‚„•")


def _out_of_place(c: str, left: str, right: str) -> bool:
    """Whether an accented letter can't stand there: a capital within a word, or a small letter of no language handled."""
    l, r = left.isascii() and left.isalpha(), right.isascii() and right.isalpha()
    return bool(c.isupper() and l and left.islower() or c not in LETTERS and c.islower() and l and r)


def _by_letters(text: str) -> str | None:
    """Single letters of one Western code page read in another, inside words."""
    best, top = None, 0
    if not _HALF.search(text):
        return None
    marks = [(c, text[i - 1 : i], text[i + 1 : i + 2]) for i, c in enumerate(text) if not c.isascii() and c not in _NEVER and not _HAN.match(c)]
    for pair, table in _images().items():
        n = bad = 0
        for c, left, right in marks:
            if c not in table:
                bad += c not in LETTERS and c.isalpha()
                continue
            l, r = left.isascii() and left.isalpha(), right.isascii() and right.isalpha()
            if c in _INNER:
                n += l and r
            elif c in LETTERS or c in FOREIGN:
                odd = _out_of_place(c, left, right)
                n += odd
                bad += not odd
            elif l or r or (table[c] in ALONE and (left + right).isspace()):
                n += 1
        if n > top and n > bad:
            top, best = n, pair
    if best is None:
        return None
    table, out = _images()[best], []
    for i, c in enumerate(text):
        left, right = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        near = (left + right).strip()
        able = c in table and (any(x.isascii() and x.isalpha() for x in near) or (not near and c not in _INNER))
        out.append(table[c] if able and (c not in LETTERS and c not in FOREIGN or _out_of_place(c, left, right)) else c)
    return "".join(out)


# Signs of ordinary text outside ASCII and Han, including the disguises of problem 5.
_ORDINARY = (
    "\u3000-\u3011\u3014-\u301b\uff01-\uff5e\u2010-\u2019\u201c\u201d\u2026\u2103\u2122\u00a9\u00ae\u00b0-\u00b2\u00d7"
    "\u00a0\u1680\u2000-\u200f\u2028-\u202f\u205f-\u206f\ufeff\u00ad\u0300-\u036f\ufe00-\ufe0f\u2e80-\u2fdf\uf900-\ufaff\ufb00-\ufb06"
    "\u2460-\u2473\u2600-\u27bf\U0001f000-\U0001faff\u2b00-\u2bff\u03b1-\u03c9\u0391-\u03a9"
)


@lru_cache(1)
def _odd() -> re.Pattern:
    """Any character that ordinary text lacks, or an ordinary one in an odd place; most texts hold none."""
    plain = "\x00-\x7f" + _ORDINARY + LETTERS + "".join(_CYR_LIKE) + "".join(sorted(c for c in _known() if _HAN.match(c)))
    return re.compile(f"[^{plain}]")


_ODD_PLACE = re.compile(
    "[ÂÃÄÅÎÏÐÑâãäåæçèéïð][\x80-\xbf]|[À-ÖØ-Þ](?<=[a-zäöüéèà].)|[\u201c\u201d\u2018\u2026±×](?<=[A-Za-z].)(?=[A-Za-z])|锟斤|斤拷|拷锟|[ΣΘΦΩΓ](?:(?<=[A-Za-z].)|[A-Za-z])"
)


def _may_be_garbled(text: str) -> bool:
    return bool(_odd().search(text) or _ODD_PLACE.search(text) or (_mostly_latin(text) and _FOREIGN.search(text)))


_LOST = re.compile("锟斤|斤拷|拷锟|[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff\U000f0000-\U0010fffd]")


def repair(text: str | None) -> str | None:
    """The original text as far as it can be had; None where the text is not garbled."""
    if not text or text.isascii() or not _may_be_garbled(text):
        return None
    out, changed = text, False
    seen = {text}
    while True:
        new = _by_sequences(out)
        if new is None:
            new = _by_bytes(out)
        if new is None or new in seen:
            break
        seen.add(new)
        out, changed = new, True
    if not changed or _may_be_garbled(out):
        new = _by_letters(out)
        if new is not None and new != out:
            out, changed = new, True
    return out if changed or _LOST.search(out) else None


@F.pandas_udf(T.StringType())
def _repair(text: pd.Series) -> pd.Series:
    return text.map(repair)


def repaired(text: Column) -> Column:
    """Original text of a garbled one, null for a text that is not garbled."""
    return F.when(F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False)), _repair(text))


def repair_text(df: DataFrame, text: str, original: str = "original") -> DataFrame:
    """``df`` with the column ``original``: the restored text of garbled rows, else null."""
    return df.withColumn(original, repaired(F.col(text)))


def is_garbled(text: str | None) -> bool:
    """Whether ``repair`` would find a garbled stretch; ends at the first proof."""
    if not text or text.isascii() or not _may_be_garbled(text):
        return False
    if _LOST.search(text):
        return True
    return any((new := f(text)) is not None and new != text for f in (_by_sequences, _by_bytes, _by_letters))


@F.pandas_udf(T.BooleanType())
def _is_garbled(text: pd.Series) -> pd.Series:
    return text.map(is_garbled).astype(bool)


def garbled(text: Column) -> Column:
    """Whether the text, at least in a stretch, was decoded with a wrong encoding; null is not."""
    return F.when(F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False)), _is_garbled(text)).otherwise(F.lit(False))

"""Personal information inside free text (problem 4): typed spans and placeholders.

Notations with a form of their own (mail, phone, identity numbers, street addresses)
are found by their grammar: these entities are held to be protected.  Names have none, so how
strongly a context reveals a person is estimated from the whole corpus.  Every
clause with a name-shaped term in it counts as (frame, term), whatever its length.  A frame discloses where

* its texts hold protected entities much oftener than others (pointwise mutual information, bits), and
* its terms, their family names and their last characters are spread (collision entropy, bits): a last
  character that is always the same belongs to the sentence.

Where several disclosing frames fit one clause, the one seen with the most different terms is likeliest.  Western names
work by pairs of capitalised words: a word whose pairs stand with protected entities or after an
introduction exceeds a threshold of information, next such contexts (two words before a pair) are judged by these
words, and the words again by the contexts.  Two such words next to each other, or two words after
such a context, are a name.  Terms above the thresholds are generalised to their type, all else stays as it is, disguised
characters included.  What is learned is sent to the tasks if it is small, else joined to the texts on its terms.

The grammars read each text once; their result is written, and only texts that may hold a name are looked at again.
Null and empty texts hold nothing, rows without a key are left out; repeated rows are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forms
from .store import written

# Common Chinese family names.
FAMILY = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
    "和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚程嵇邢裴陆荣翁荀羊惠甄曲封芮储靳焦巴弓牧隗"
    "山谷车侯宓蓬全班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶黎薄印宿白怀蒲台从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰雍桑桂牛寿通边扈燕冀浦尚农温别庄晏柴瞿阎充慕连茹习艾鱼容向古易慎戈廖庾终居衡步都耿满弘匡国文寇广禄阙东欧沃利蔚越夔隆师巩厍聂晁勾敖融冷辛阚简饶曾沙养鞠须丰关查后荆红游竺权盖益桓公"
    "段肖闫覃佟逯亓仝邸仉揭岳涂晋佘缑佴牟阳付代楚佀庹"
)
DOUBLE_FAMILY = "欧阳 司马 上官 诸葛 夏侯 司徒 令狐 慕容 皇甫 尉迟 公孙 长孙 宇文 端木 南宫 东方 独孤 西门 轩辕 百里 申屠 太史 澹台 闻人 东郭 呼延 钟离 鲜于 司空 万俟".split()
# How people are introduced in general; all other contexts are learned.
FRAMES = ["我叫□", "我是□", "本人□", "联系人□", "收件人□", "姓名□"]
CUES = r"[Hh]ier|[Ii]ci|I am|I'm|this is|my name is|my (?:sister|brother|mother|father|wife|husband|friend|colleague|neighbour|mum|mom|dad)|[Dd]ear|[Ii]ch heiße|[Ii]ch bin|[Mm]ein Name ist|[Mm]eine? (?:Schwester|Bruder|Mutter|Vater|Frau|Mann|Kollegin|Kollege)|[Gg]uten Tag|[Jj]e suis|[Jj]e m'appelle|au nom de|[Mm]a (?:sœur|mère|femme|collègue)|[Mm]on (?:frère|père|mari|collègue)|[Bb]onjour|[Cc]hère?"
#: Thresholds in bits: of a frame's terms, their family names and last characters (chance that two occurrences agree),
#: of its information about protected entities; of a Western word's and context's information about disclosure.
BITS, FAMILY_BITS, END_BITS, HELD_BITS, WORD_BITS, CUE_BITS = 4.0, 3.0, 2.5, 1.0, 1.5, 2.0
#: Learned keys that are sent to every task; more are joined to the texts.
MOST_KEYS = 200_000
#: Longer sides of a frame stand as a digest and this many characters next to the term: a clause of any length costs in proportion to it.
SIDE = 32

_TYPES = ("email", "id_number", "phone", "address", "person_name")
_NOT = re.compile(r"(?:订单号?|单号|批号|批次|备案编?号?|编号|[Oo]rder(?: no\.?)?|[Ll]ot|LOT|[Bb]atch|[Cc]harge|[Bb]estellung|[Aa]uftrag|[Cc]ommande|运单|快递)[\s:：#是为]*(?:n°|Nr\.?|no\.?)?\s*$")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\(\[（【]\s?(?:dot|点|punkt|point)\s?[\)\]）】]\s?|\s(?:dot|punkt|point)\s)"
_AT = r"(?:\s?@\s?|\s?＠\s?|\s?[\(\[（【]\s?(?:at|AT|@)\s?[\)\]）】]\s?|\s(?:at|AT)\s|#)"
_EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z])(?:（#换成@）|\(#换成@\))?")
_DATE = r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
_ID = re.compile(
    rf"(?<!\d)\d{{6}}[ -]?{_DATE}[ -]?\d{{3}}[\dXx](?![\dA-Za-z])"
    r"|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
    r"|(?:[Pp]assport|护照|[Pp]asseport|[Rr]eisepass|[Aa]usweis|[Cc]arte d'identité|证件)[\w°.:： ]{0,14}?(?<![A-Za-z0-9])(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{7,10}(?![A-Za-z0-9])"
    r"|(?<!\d)[1-9] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})(?![\d])"
    r"|(?:SSN|[Ss]ocial security|社保(?:号码|卡号|号)?|[Ss]ozialversicherungs(?:nummer|nr\.?)|SV-?Nr\.?|[Ss]écu\w*)[^\w]{0,3}(?:n°|no\.?|Nr\.?)?\s?(?=(?:\D?\d){8})[A-Z0-9][A-Z0-9 /-]{7,18}[A-Z0-9]"
)
_HAN_DIGIT = "零〇一二三四五六七八九幺"
_PHONE = re.compile(
    r"(?<![\d.A-Za-z-])(?:\(?(?:\+|00)?86\)?[ -]?)?1[3-9]\d(?:[ .-]?\d){8}(?![\d])"
    rf"|(?<![{_HAN_DIGIT}])[一幺][三四五六七八九][{_HAN_DIGIT}]{{9}}(?![{_HAN_DIGIT}])"
    r"|(?<![\d-])\(?0[1-9]\d{1,2}\)?[ -]?\d{7,8}(?:转\d{1,6}|-\d{1,5})?(?!\d)"
    r"|(?<![\d-])\(?(?:\+|00)[1-9]\d{0,2}\)?(?:[ ./()-]{0,2}\d){7,12}(?!\d)"
    r"|(?<![\d.-])(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?<![\d.-])0[1-9](?:[ .-]?\d{2}){4}(?!\d)"
    r"|(?<![\d.-])0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,2}(?!\d)"
    r"|(?<![\d.-])07\d{3} ?\d{3} ?\d{3}(?!\d)"
)
_SERVICE = re.compile(r"^\D*(?:\+?1[ .-])?(?:0?800|400|888|877|866|855|844|833)(?=[ .-]?\d)")
_NUM = r"(?:\d+|[零〇一二三四五六七八九十百两]+)"
_UNIT = rf"(?:之\s?\d+)?(?:\s?{_NUM}[号栋幢座楼弄])?(?:\s?[A-Za-z\d]+\s?单元)?(?:\s?\d+\s?[室户]|\s?\d{{3,4}}(?!\d))?"
_STREETS = "路街巷弄道同里区寓园村苑厦庭场庄都府"
_ADDRESS = re.compile(
    rf"(?:[一-鿿]{{2,3}}省)?(?:[一-鿿]{{2,3}}市)?(?:[一-鿿]{{1,3}}[区县镇乡])*[一-鿿]{{1,4}}?(?:路|街|巷|弄|道|胡同|里)\s?{_NUM}\s?[号弄]{_UNIT}"
    rf"|(?:[一-鿿]{{2,3}}省)?(?:[一-鿿]{{2,3}}市)?(?:[一-鿿]{{1,3}}[区县镇乡])*[一-鿿]{{1,5}}?(?:小区|公寓|花园|新村|家园|大厦|苑|庭|广场|山庄|名都|府)\s?{_NUM}\s?[号栋幢座楼]{_UNIT}"
)
_ADDRESS_EN = re.compile(
    r"(?<!\d)\d{1,5}[A-Za-z]? (?:[A-Z][\w'’-]+ ){1,3}(?:Avenue|Ave|Street|St|Road|Rd|Close|Lane|Ln|Drive|Dr|Way|Court|Ct|Terrace|Place|Pl|Crescent|Square|Boulevard|Blvd|Row|Walk|Gardens|Hill)\b\.?(?:, (?:Flat|Unit|Apt\.?|Suite) ?\w+)?"
)
_ADDRESS_DE = re.compile(
    r"(?:(?:Am|An der|Auf der|Im|Zum|Zur) )?[A-ZÄÖÜ][\wäöüß-]{2,}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|chaussee|steig|hof|hang|anger|pfad|steg|kamp|graben|rain)\s?\d{1,4}[a-z]?\b"
    r"|[A-ZÄÖÜ][\wäöüß-]+ (?:Str\.|Straße|Strasse|Weg|Platz|Allee|Damm|Ufer|Ring|Chaussee|Gasse|Steig)\s?\d{1,4}[a-z]?\b"
)
_ADDRESS_FR = re.compile(
    r"(?<!\d)\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|allée|chemin|place|boulevard|bd\.?|impasse|quai|route|sentier|venelle|ruelle) [\w'’éèàâêîôûç -]{2,40}",
)
_NUMBER = re.compile(r"\d[\d .()/-]{5,}\d")
_HAN_NUMBER = re.compile(f"[{_HAN_DIGIT}]{{11}}")
_AT_SIGN = re.compile(_AT)
_ID_WORDS = re.compile("ass|护照|证件|社保|usweis|identité|SSN|ocial|ozial|SV|écu")
# Of each grammar, what every text that it matches holds; most texts hold none of it.
_GRAMMARS = (
    ("email", lambda s, n: ("@" in s or "#" in s or "at" in s or "AT" in s or "＠" in s) and _AT_SIGN.search(s), _EMAIL),
    ("id_number", lambda s, n: n or _ID_WORDS.search(s), _ID),
    ("phone", lambda s, n: n or _HAN_NUMBER.search(s), _PHONE),
    ("address", lambda s, n, r=re.compile(rf"[{_STREETS}]\s?{_NUM}\s?[号弄栋幢座楼]"): r.search(s), _ADDRESS),
    ("address", lambda s, n, r=re.compile(r"\d[A-Za-z]? [A-Z][\w'’-]+ [A-Z]"): r.search(s), _ADDRESS_EN),
    ("address", lambda s, n, r=re.compile(r"(?:aße|asse|tr\.|eg|latz|llee|ing|fer|amm|ussee|teig|hof|hang|nger|fad|teg|amp|aben|rain)\s?\d"): r.search(s), _ADDRESS_DE),
    ("address", lambda s, n, r=re.compile(r"\d(?: ?(?:bis|ter|quater))?,? (?:rue|av|all|chem|pl|bo|bd|imp|quai|route|sent|ven|ruel)"): r.search(s), _ADDRESS_FR),
)
# Grammars that match without a digit.
_WITHOUT_DIGITS = tuple(g for g in _GRAMMARS if g[2] in (_EMAIL, _PHONE, _ADDRESS))
_DIGIT = re.compile(r"\d")
_LEAD = re.compile("^(?:样品)?(?:我在|我住|住在|住|寄到|寄往|寄至|在|到|往|为|记为|是|至|店在)+")
_CLAUSE = re.compile(r"(?<![^\W_])[一-鿿]{2,}+(?![^\W_])")
_NAME_START = re.compile("(?:" + "|".join(DOUBLE_FAMILY) + f")|[{FAMILY}]")
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+)*"
_WEST = re.compile(rf"(?<![\w'’])({_CAP})(, | )({_CAP})(?![\w])(?!\s?\d)")
_CUED = re.compile(rf"(?:^|(?<=\W))(?:{CUES})(?: an| auf)? ({_CAP})(, | )({_CAP})(?![\w])")
_NO_NAME = frozenset("Das Der Die Den Dem Des Ein Eine Einen Einer Im Am An Auf Laut Zum Zur Le La Les Un Une Du Au My Our Your His Her A Near At In For From With When After Before If Is Does Can How What Where Who Why Wie Was Ist Darf Wer Wo Combien Est Puis Peut Que Qui Où Compared Unless According During Staff The This Batch Tel Mail Hotline Lot Order Frau Herr Herrn Dr Prof Mme Madame Mlle Monsieur M Mr Mrs Ms Miss Sir".split())
_BEFORE = re.compile(r"[\w'’]+")
_TWO_WORDS = re.compile("[a-zß-ÿ'’],? [A-ZÀ-Þ]")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text with disguises undone character by character, and where each character comes from (None: unchanged)."""
    if text.isascii() or not forms.disguised(text):
        return text, None
    out, at, i = [], [], 0
    gone = {k for m in forms._GONE.finditer(text) for k in range(*m.span())}
    for i, c in enumerate(text):
        if i in gone or ("\u0300" <= c <= "\u036f"):
            continue
        new = c.translate(forms._TABLE)
        out.append(new)
        at += [i] * len(new)
    s = "".join(out)
    own = bool(forms._CYRILLIC_OWN.search(s))
    for m in list(forms._words(s, own)):
        s = s[: m.start()] + m.group().translate(forms._PROTOTYPE) + s[m.end() :]
    return s, at


def _digests(text: str) -> list[str]:
    """Of each beginning of a text, the digest."""
    digest, out = blake2b(digest_size=SIDE // 2), []
    for c in text:
        out.append(digest.hexdigest())
        digest.update(c.encode())
    return [*out, digest.hexdigest()]


def _terms(clause: str) -> Iterator[tuple[int, int, str, str]]:
    """Begin and end of each name-shaped term in a clause, and the two sides of its frame."""
    size, heads, tails = len(clause), None, None
    for k in _NAME_START.finditer(clause):
        a, b = k.span()
        if a <= SIDE:
            head = clause[:a]
        else:
            heads = heads or _digests(clause)
            head = heads[a] + clause[a - SIDE : a]
        for end in (b + 1, b + 2):
            if end > size or not a and end == size:
                continue
            if size - end <= SIDE:
                yield a, end, head, clause[end:]
            else:
                tails = tails or _digests(clause[::-1])
                yield a, end, head, tails[size - end] + clause[end : end + SIDE]


def frames_of(text: str) -> Iterator[tuple[str, str]]:
    """(frame, term) of clauses with a name-shaped term."""
    for m in _CLAUSE.finditer(text):
        clause = m.group()
        for a, end, head, tail in _terms(clause):
            yield f"{head}□{tail}", clause[a:end]


def pairs_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Begin and end of two capitalised words, and they themselves."""
    if _TWO_WORDS.search(text):
        for m in _WEST.finditer(text):
            if m[1] not in _NO_NAME and m[3] not in _NO_NAME:
                yield m.start(), m.end(), m[1], m[3]


def before(text: str, a: int) -> str:
    """The two words before a place."""
    return " ".join(_BEFORE.findall(text, max(0, a - 40), a)[-2:]).lower()


def _anchors(parts: set[str]):
    """Automaton over the longer sides of frames."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in parts or {"\x00"}:
        found.add_word(p, 1)
    found.make_automaton()
    return found


def entities(s: str) -> tuple[list[tuple[int, int, str]], str]:
    """Typed spans of the protected entities of a plain text, and the text without them and without numbers of orders and lots."""
    found: list[tuple[int, int, str]] = []
    taken, digit = s, _DIGIT.search(s)
    number = _NUMBER.search(s) if digit else None
    for kind, needed, pattern in _GRAMMARS if digit else _WITHOUT_DIGITS:
        if not needed(s, number):
            continue
        for m in pattern.finditer(taken):
            a, b = m.span()
            if kind in ("id_number", "phone") and _NOT.search(s[max(0, a - 14) : a]):
                taken = taken[:a] + "\x00" * (b - a) + taken[b:]
                continue
            if kind == "phone" and _SERVICE.match(m.group()):
                continue
            if kind == "address":
                lead = _LEAD.match(m.group())
                a += lead.end() if lead else 0
            found.append((a, b, kind))
        taken = _without(taken, found)
    return found, taken


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, _ in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


class Knowledge:
    """What the corpus has disclosed: (kind, value) → weight, of frames around Chinese names, contexts and words of Western names."""

    def __init__(self, known: dict[tuple[str, str], int] | None = None, seeds: bool = True):
        self.known = dict(known or {})
        if seeds:
            self.known |= {("frame", f): max(1, self.known.get(("frame", f), 1)) for f in FRAMES}
        self.seeds = seeds
        parts = [f.partition("□") for k, f in self.known if k == "frame"]
        self.heads, self.tails = {a for a, _, _ in parts} | {""}, {b for _, _, b in parts}
        self.open = {b for a, _, b in parts if not a}
        self.anchors = _anchors({max(a, b, key=len)[-SIDE:] for a, _, b in parts})
        self.words = {v for k, v in self.known if k == "word"}
        self.cues = {v for k, v in self.known if k == "cue"}

    def names(self, s: str) -> Iterator[tuple[int, int]]:
        known = self.known
        for m in _CLAUSE.finditer(s) if next(self.anchors.iter(s), None) else ():  # most texts hold no part of a frame
            clause, fits = m.group(), []
            for a, end, head, tail in _terms(clause):
                if tail in self.tails:
                    weight = known.get(("frame", f"{head}□{tail}"), 0) if head in self.heads else 0
                    if not weight and tail and tail in self.open:  # another clause may stand before without a sign between
                        weight = known.get(("frame", "□" + tail), 0)
                    if weight:
                        fits.append((-weight, a, -end))
            if fits:
                _, a, end = min(fits)
                yield m.start() + a, m.start() - end
        if not _TWO_WORDS.search(s):
            return
        if self.seeds:
            for m in _CUED.finditer(s):
                if m[1] not in _NO_NAME and m[3] not in _NO_NAME:
                    yield m.start(1), m.end(3)
        for a, b, x, y in pairs_of(s) if self.words or self.cues else ():
            if x in self.words and y in self.words or self.cues and before(s, a) in self.cues:
                yield a, b

    def spans(self, s: str) -> list[tuple[int, int, str]]:
        """Typed spans (start, end, type) of a plain text, none overlapping another."""
        found, rest = entities(s)
        for a, b in self.names(rest):
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, "person_name"))
        return sorted(found)

    def of(self, text: str | None) -> list[tuple[int, int, str]]:
        """Spans in the text as it is."""
        if not text:
            return []
        s, at = plain(text)
        return [(a, b, k) if at is None else (at[a], at[b - 1] + 1, k) for a, b, k in self.spans(s)]


_READ = "kinds array<string>, rest string, key bigint, held boolean, frames array<struct<context: string, term: string>>, pairs array<struct<context: string, term: string, other: string, held: boolean>>"


def _lists(rows: list[list[tuple]], names: str, types: list[pa.DataType]) -> pa.ListArray:
    """One list of structs per row."""
    offsets, each = [0], []
    for r in rows:
        each += r
        offsets.append(len(each))
    columns = list(zip(*each)) if each else [()] * len(types)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names.split()))


def _reader(seeds: bool, keep: list[str]):
    """Per text, beside the columns to keep: the protected entities; the rest of it where it may hold a name; frames with their terms and pairs with their contexts, whether protected entities stand beside them, and a key of what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, rests, keys, helds, frames, pairs = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = plain(text)[0] if text else ""
                spans, rest = entities(s)
                own, s = bool(spans), _without(s, spans)  # no names inside
                new, two, able = list(set(frames_of(s))), [], bool(_TWO_WORDS.search(rest))
                if found := list(pairs_of(s)):
                    cued = {m.start(1) for m in _CUED.finditer(s)} if seeds else ()
                    two = list({(before(s, a), x, y, own or a in cued) for a, _, x, y in found})
                able = able or (bool(new) if rest == s else next(frames_of(rest), None) is not None)
                kinds.append(sorted({k for _, _, k in spans}))
                rests.append(rest if able else None)
                keys.append(int.from_bytes(md5(s.encode("utf-8", "replace")).digest()[:8], "big", signed=True) if new or two else None)
                helds.append(own if text else None)
                frames.append(new)
                pairs.append(two)
            string = pa.string()
            columns = [pa.array(kinds, pa.list_(string)), pa.array(rests, string), pa.array(keys, pa.int64()), pa.array(helds, pa.bool_())]
            columns += [_lists(frames, "context term", [string] * 2), _lists(pairs, "context term other held", [string] * 3 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=[*keep, "kinds", "rest", "key", "held", "frames", "pairs"])

    return run


def read(texts: DataFrame, seeds: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The written result of one reading of column ``text``, with a number of each row and the columns ``keep`` (all)."""
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    keep = [c for c in texts.columns if keep is None or c in keep or c == "row"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    return written(texts.mapInArrow(_reader(seeds, keep), f"{schema}, {_READ}"), "texts")


def _bits(held, n, base):
    """Information of an event about disclosure: how much oftener it comes with it than all do, in bits; one more of the common kind is taken as seen."""
    return F.log2((held + base) / (n + 1) / base)


def learn(texts: DataFrame, *, bits: float = BITS, family_bits: float = FAMILY_BITS, end_bits: float = END_BITS, held_bits: float = HELD_BITS, word_bits: float = WORD_BITS, cue_bits: float = CUE_BITS) -> DataFrame:
    """(kind, value, weight): disclosing frames, contexts and words of the whole corpus that was read, by counts over different texts."""
    each = lambda kind: texts.select("key", F.col("held").cast("int").alias("beside"), F.explode(kind).alias("x"))
    share = lambda df: df.agg(((F.coalesce(F.sum(F.col("held").cast("int")), F.lit(0)) + 1) / (F.count("held") + 2)).alias("r")).first()["r"]
    terms = each("frames").select("x.context", "x.term", "key", F.col("beside").alias("held")).distinct().groupBy("context", "term").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    terms = written(terms, "terms")
    pairs = written(each("pairs").select("x.context", "x.term", "x.other", "key", F.col("x.held").cast("int").alias("held")).distinct(), "pairs")
    agree = lambda by, name: terms.groupBy("context", by.alias("x")).agg(F.sum("n").alias("n")).groupBy("context").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias(name))
    whole = terms.groupBy("context").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("*").alias("weight"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    spread = lambda c: F.log2(F.col("n") * (F.col("n") - 1) / (F.col(c) + 1))
    base = F.lit(share(texts))
    frames = whole.where((F.col("n") > 1) & (spread("same") >= bits) & (_bits(F.col("held"), F.col("n"), base) >= held_bits))
    frames = frames.join(agree(F.substring("term", 1, 1), "kin"), "context").join(agree(F.right("term", F.lit(1)), "ends"), "context")
    frames = frames.where((spread("kin") >= family_bits) & (spread("ends") >= end_bits)).select(F.lit("frame").alias("kind"), F.col("context").alias("value"), "weight")

    pairs, rate = pairs.select("context", "term", "other", "held"), F.lit(share(pairs))
    each = lambda p: p.select(F.explode(F.array("term", "other")).alias("value"), "held").groupBy("value").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    strong = lambda p: each(p).where(_bits(F.col("held"), F.col("n"), rate) >= word_bits)
    first = strong(pairs).select(F.col("value"), F.lit(1).alias("ok"))
    both = pairs.join(first.withColumnsRenamed({"value": "term", "ok": "x"}), "term", "left").join(first.withColumnsRenamed({"value": "other", "ok": "y"}), "other", "left")
    by_cue = both.where("context <> ''").groupBy("context").agg(F.count("*").alias("n"), F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)).alias("held"))
    cues = by_cue.where((F.col("held") >= 2) & (2 * F.col("held") >= F.col("n")) & (_bits(F.col("held"), F.col("n"), rate) >= cue_bits)).select(F.col("context"), F.col("held").alias("weight"))
    again = pairs.join(cues.select("context", F.lit(1).alias("c")), "context", "left").withColumn("held", F.greatest("held", F.coalesce("c", F.lit(0))))
    words = strong(again).select(F.lit("word").alias("kind"), "value", F.col("n").alias("weight"))
    return frames.unionByName(words).unionByName(cues.select(F.lit("cue").alias("kind"), F.col("context").alias("value"), "weight"))


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text, the keys that it could use."""
    for rows in batches:
        out = []
        for row, s in zip(rows["row"], rows["rest"]):
            keys = {("frame", f) for frame, _ in frames_of(s) for f in (frame, "□" + frame.partition("□")[2])}
            for a, _, x, y in pairs_of(s):
                keys |= {("cue", before(s, a)), ("word", x), ("word", y)}
            out += [(row, k, v) for k, v in keys]
        yield pd.DataFrame(out, columns=["row", "kind", "value"])


def _with_knowledge(rows: DataFrame, known: DataFrame, seeds: bool, work, schema: str) -> DataFrame:
    """``work`` (rows, knowledge of each → rows) over texts that were read, with what the corpus discloses: sent to the tasks where it is at most ``MOST_KEYS``, else joined to the texts that could use it."""
    if known.count() <= MOST_KEYS:
        own = Knowledge({(r["kind"], r["value"]): r["weight"] for r in known.collect()}, seeds)

        def all_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield work(rows, [own] * len(rows))

        return rows.mapInPandas(all_rows, schema)
    hits = rows.where("rest is not null").select("row", "rest").mapInPandas(_asked, "row bigint, kind string, value string").join(known, ["kind", "value"])
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("kind", "value", "weight")).alias("known"))  # bounded by the length of the text

    def own_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield work(rows, [Knowledge({(k["kind"], k["value"]): k["weight"] for k in (x if x is not None else ())}, seeds) for x in rows["known"]])

    return rows.join(hits, "row", "left").mapInPandas(own_rows, schema)


def _named(rows: pd.DataFrame, known: list[Knowledge]) -> pd.DataFrame:
    return rows.loc[[next(own.names(s), None) is not None for s, own in zip(rows["rest"], known)], ["id", "field_name"]].assign(pii_type="person_name")


def clean(text: str | None, known: Knowledge) -> str | None:
    """The text with each span replaced by a placeholder of its type."""
    spans = known.of(text)
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in spans:
        parts += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


def _clean(rows: pd.DataFrame, known: list[Knowledge]) -> pd.DataFrame:
    return rows[["id", "field_name"]].assign(text=[clean(t, own) for t, own in zip(rows["text"], known)])


def fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, field_name, text): the columns one below the other."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns])).alias("f")
    return df.select(F.col(key).cast("bigint").alias("id"), each).select("id", "f.field_name", "f.text").where((F.coalesce(F.col("text"), F.lit("")) != "") & F.col("id").isNotNull())


def find(df: DataFrame, key: str, columns: list[str], *, seeds: bool = True) -> DataFrame:
    """(id, field_name, pii_type): one row per row, field and type found.  ``seeds``: whether general introductions are known beforehand."""
    texts = read(fields(df, key, columns), seeds, ["id", "field_name"])
    able = texts.where("rest is not null").select("row", "id", "field_name", "rest")
    names = _with_knowledge(able, written(learn(texts), "known"), seeds, _named, "id bigint, field_name string, pii_type string")
    return texts.select("id", "field_name", F.explode("kinds").alias("pii_type")).unionByName(names)


def redact(df: DataFrame, key: str, columns: list[str], *, seeds: bool = True) -> DataFrame:
    """(id, field_name, text): the texts with each span replaced by a placeholder of its type; null and empty texts are left out."""
    texts = read(fields(df, key, columns), seeds)
    able = (F.size("kinds") > 0) | F.col("rest").isNotNull()
    rows = texts.where(able).select("row", "id", "field_name", "text", "rest")
    changed = _with_knowledge(rows, written(learn(texts), "known"), seeds, _clean, "id bigint, field_name string, text string")
    return texts.where(~able).select("id", "field_name", "text").unionByName(changed)

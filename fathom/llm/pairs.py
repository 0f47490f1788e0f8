"""Broken prompt and response pairs (problem 3): each defective pair with its kind of defect.

A pushdown parser over fences, brackets, quotations, emphasis, tags, list items and table rows
tells what is still open where a text ends, greedy string tiling how much of an answer repeats
its question, scripts and function words which language it is in, and a small grammar
whether it only declines.
Garbled answers are judged by their repaired text, disguised ones by their consistent
form.

Null or blank questions are never a case; a null hit counts as no hit; work is per row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import forms, garble

DEFECTS = ("empty", "copied", "refusal", "other_language", "truncated")
SHORT, LEAD_HAN, LEAD_WORDS, TILE = 20, 8, 28, 4

# Words that stand for no answer.
NULL_WORDS = frozenset("n/a na null none nil nan undefined nothing unknown tbd todo 无 空 暂无 没有 无内容 无答案 略 keine aucun aucune".split())
_MARKUP = re.compile(r"<[^<>]{0,80}>|&[a-z]+;|[#*_`~|>]+")
_MARKED = re.compile("[<&#*_`~|>]")
_LETTER = re.compile(r"[^\W_]")
_OTHER = re.compile(r"[\W_]+")
# Headings of the sectioned layout.
_TITLE = re.compile(r"(?:（资料提取）|\(资料提取\)|\(from the files\)|\(aus den Unterlagen\)|\(extrait des fiches\))\s?[：:]")
_CONCLUSION = re.compile(r"(?:^|\n)\s*(?:结论|Conclusion|Ergebnis)\s?[：:]")
_NOTES = re.compile(r"(?:^|\n)\s*(?:注意事项|需医生评估项|Notes|Hinweise|Remarques)\s?[：:]")
_ITEM = re.compile(r"^\s*[-•*·]\s*\S")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "‘": "’", "«": "»", "{": "}", "〔": "〕", "〈": "〉"}
_CLOSERS = {v: k for k, v in _PAIRS.items()} | {"“": "„"}
_END = "。！？!?｡."
_TAIL = re.compile(r"[\s\U0001f000-\U0001faff☀-➿️‍]+$")
_DOTS = re.compile(r"(?:…|\.{2,}|。{2,}|\.\s\.\s?\.)+[\s”\"'」』）)\]】»›’]*$")
# How answers decline, by language: what every match holds one of, and the grammar; and the courtesies around it.
_REFUSALS = (
    (
        "不予 停止生成 作答 回答 回复 答复 评论 讨论 透露 帮助 建议 意见 信息 给出 不便多说 不方便 聊点别的 换个话题 没有办法 没有资格 拒绝 范围 无可奉告 爱莫能助".split(),
        re.compile(
            "不予回[复应答]|停止生成|不作答|不做回答|(?:不能|无法|不便|不可以|没法|不会)(?:对此|就此|为您|给您|直接)?(?:回答|回复|作答|答复|评论|讨论|透露|提供(?:任何)?(?:帮助|建议|意见|信息|回答))|无法就.{1,30}给出|不便多说|不方便(?:展开|多说|透露|回答|讨论)|聊点别的|换个话题"
            "|没有办法(?:提供|回答|协助)|没有资格|拒绝(?:讨论|回答|评论|作答|透露)|超出了?我?(?:能|可以)?(?:协助|回答|处理|服务)的?范围|无可奉告|不予置评|不作评论|爱莫能助"
        ),
    ),
    (
        ["can't", "cannot", "can not", "won't", "will not", "able to", "allowed to", "permitted to", "may not", "comment", "declin", "refus", "rather not"],
        re.compile(r"(?:can(?:no|')t|cannot|can not|won't|will not|(?:un|not )able to|not allowed to|not permitted to|may not)\s(?:\w+\s){0,3}?(?:help|answer|assist|comment|discuss|respond|say|talk|share|speak|advise)\b|(?:can(?:no|')t|cannot|will not|won't) be (?:fulfilled|answered|processed|completed|handled)|no comment|(?:must|have to) (?:decline|refuse)|declines? to (?:answer|comment|say)|refuse to (?:answer|comment|discuss)|rather not (?:say|talk|discuss)", re.I),
    ),
    (
        "nicht kein lehn verweiger".split(),
        re.compile(r"nicht (?:weiter)?(?:helfen|beantworten|antworten|kommentieren|äußern|bearbeitet|behandelt|sagen|besprechen)|nichts (?:dazu )?sagen|dazu nichts|keine (?:Auskunft|Antwort|Angaben?|Aussage)\b|[Kk]ein Kommentar|(?:lehne|lehnt|lehnen)\b.{0,40}\bab\b|verweiger|ablehnen", re.I),
    ),
    (
        "peux peut pouvons puis saurais suis sommes sera commentaire refus déclin".split(),
        re.compile(r"(?:ne|n')\s?(?:peux|peut|pouvons|puis|saurais|suis|sommes)\s(?:pas|en mesure)?.{0,30}(?:répondre|aider|commenter|dire|discuter|prononcer|mesure|autorisé|habilité)|ne sera pas (?:traitée?|donnée?)|[Ss]ans commentaire|[Pp]as de commentaire|(?:dois|devons) (?:décliner|refuser)|refuse de|décline", re.I),
    ),
)
_COURTESY = re.compile(r"感谢|谢谢|祝您|祝你|生活愉快|抱歉|对不起|不好意思|请谅解|敬请|见谅|^\W*(?:thanks?|thank you|have a nice|sorry|merci|bonne journée|danke|schönen tag|viele grüße|désolée?|es tut mir leid|leider)|语言程序|智能助手|assistant", re.I)
_SENTENCE = re.compile(r"[^。！？!?\n～]*?(?:[。！？!?\n～]+|\.(?=\s|$)|$)")
# Frequent function words of the languages handled.
WORDS = {
    "en": frozenset("the of and is are for with to how what in on a an after does can i not no yes about hours every week weeks do my who makes much long which it this be at from goes fine people should if when under during according staff were must into than per or has have you we your asks too".split()),
    "de": frozenset("der die das und ist für mit nach wie was auf ein eine einer ich darf nicht den dem des zu im bei ja nein etwa stunden alle wochen sich tun an oft wird gilt laut von vom zur zum aus oder wer wo hält lange geeignet normal verträgt im liegt wurde sind kein keine leider noch hier".split()),
    "fr": frozenset("le la les et est pour avec après comment que sur un une je puis des du en à dans oui non environ heures toutes semaines l d combien de fois répéter peut-on mêler où vérifier puis-je me doucher convient-il quel selon au aux ce cette pas n qui est-ce jamais par rapport vers rien sont".split()),
}
_ANY_WORD = frozenset().union(*WORDS.values())
_WORD = re.compile(r"[a-zäöüßéèêëàâçîïôûùœæ]+(?:-(?:je|on|il|ce))?")
_HAN = re.compile("[㐀-鿿]")
_HAN_RUNS = re.compile("[㐀-鿿]+")
_HAN_LETTERS = re.compile("[㐀-䶿一-鿿]")
_NOISE = re.compile(r"[\w.+-]+[@＠][\w.-]+|https?://\S+|[A-Za-z]+\.txt")
_ASKED = re.compile(
    r"(?:用|以)?(?P<zh>英文|英语|德文|德语|法文|法语|中文|汉语)(?:回答|回复|作答|答复|说明|解释|答)|(?:[Aa]nswer|[Rr]eply|[Rr]espond|[Ww]rite|[Ee]xplain)\w*\s(?:\w+\s)?in (?P<en>English|German|French|Chinese)"
    r"|auf (?P<de>Englisch|Deutsch|Französisch|Chinesisch)|(?:[Rr]épond\w*|[Éé]criv\w*|[Rr]éponse)\s?(?:\w+\s)?en (?P<fr>anglais|allemand|français|chinois)"
)
_LANGUAGE = {"英文": "en", "英语": "en", "德文": "de", "德语": "de", "法文": "fr", "法语": "fr", "中文": "zh", "汉语": "zh"} | dict(
    zip("English German French Chinese Englisch Deutsch Französisch Chinesisch anglais allemand français chinois".split(), "en de fr zh en de fr zh en de fr zh".split())
)


def _title(text: str) -> re.Match | None:
    return _TITLE.search(text) if "（" in text or "(" in text else None


def _body(text: str) -> str:
    """The text without spaces and emoji at its end."""
    return _TAIL.sub("", text) if text and _TAIL.match(text, len(text) - 1) else text


def is_empty(answer: str) -> bool:
    """No content word, or only a title with an empty conclusion."""
    s = _MARKUP.sub(" ", answer) if _MARKED.search(answer) else answer
    if not _LETTER.search(s):
        return True
    bare = s.strip().strip("。.!！?？-—()（）[]【】\"'“”「」 ").lower()
    if bare in NULL_WORDS:
        return True
    m = _title(s)
    if m:
        rest = _CONCLUSION.sub("\n", s[m.end() :])
        return not _LETTER.search(rest)
    return False


def letters(text: str) -> str:
    return _OTHER.sub("", text).lower()


def tiling(a: str, b: str, least: int = TILE) -> int:
    """Greedy string tiling: letters of ``a`` in tiles, the longest common runs of unmarked letters first, of ``least`` or more.

    Letters of a tile are marked on both sides; when no tile is left, the marks of ``b`` are lifted, as a question may be repeated.
    """
    marked_a, covered = bytearray(len(a)), 0
    grams: dict[str, list[int]] = {}
    for j in range(len(b) - least + 1):
        grams.setdefault(b[j : j + least], []).append(j)
    while True:
        marked_b, before = bytearray(len(b)), covered
        while True:
            best, tiles, i = least - 1, [], 0
            while i <= len(a) - least:
                if marked_a[i]:
                    i += 1
                    continue
                longest = 0
                for j in grams.get(a[i : i + least], ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                        n += 1
                    longest = max(longest, n)
                    if n > best:
                        best, tiles = n, [(i, j)]
                    elif n == best:
                        tiles.append((i, j))
                i += max(1, longest - best + 1)  # a longer tile can't begin before
            if not tiles:
                break
            for i, j in tiles:
                if not any(marked_a[i : i + best]) and not any(marked_b[j : j + best]):
                    marked_a[i : i + best] = marked_b[j : j + best] = b"\x01" * best
                    covered += best
        if covered == before:
            return covered


def is_copied(question: str, answer: str) -> bool:
    """Nothing but the question, once or repeated, apart from a short lead-in: tiles of the question cover the answer."""
    if (new := set(answer).difference(question)) and len(_HAN_LETTERS.findall("".join(new))) > (LEAD_HAN if _HAN.search(answer[:12]) else LEAD_WORDS):
        return False  # letters that the question lacks are in no tile
    q, a = letters(question), letters(answer)
    if len(q) < 4 or len(a) < 0.9 * len(q):
        return False
    lead = LEAD_HAN if _HAN.search(answer[:12]) or len(_HAN.findall(answer)) > 0.3 * len(a) else LEAD_WORDS
    known = {q[j : j + TILE] for j in range(len(q) - TILE + 1)}
    missed, most = 0, lead + TILE * (2 + len(a) // len(q))  # what the lead-in and the seams between tiles may miss
    for i in range(len(a) - TILE + 1):
        if a[i : i + TILE] not in known:
            missed += 1
            if missed > most:
                return False
    covered = tiling(a, q)
    return len(a) - covered <= lead and covered >= 0.95 * len(q)


def declines(text: str) -> bool:
    low = text.lower()
    return any(grammar.search(text) for hints, grammar in _REFUSALS if any(h in low for h in hints))


def is_refusal(answer: str) -> bool:
    """Declines, and says nothing else."""
    if not declines(answer):
        return False
    found, rest = False, 0
    for s in _SENTENCE.findall(answer):
        if not s.strip():
            continue
        if declines(s):
            found = True
            tail = re.split(r"[：:]", s, maxsplit=1)
            if len(tail) == 2 and len(letters(tail[1])) > 12 and not declines(tail[1]):
                rest += len(letters(tail[1]))
        elif not _COURTESY.search(s):
            rest += len(letters(s))
    return found and rest <= 14


#: Scripts that tell a language by themselves.
_SCRIPTS = {"ja": re.compile("[\u3041-\u30fa\u30fc]"), "ko": re.compile("[\u1100-\u11ff\uac00-\ud7a3]"), "ru": re.compile("[\u0400-\u04ff]"), "el": re.compile("[\u0370-\u03ff]"), "ar": re.compile("[\u0600-\u06ff]"), "he": re.compile("[\u0590-\u05ff]"), "th": re.compile("[\u0e00-\u0e7f]"), "hi": re.compile("[\u0900-\u097f]")}
_OTHER_SCRIPT = re.compile("[\u0370-\u07ff\u0900-\u0e7f\u1100-\u11ff\u3041-\u30fc\uac00-\ud7a3]")


def language(text: str) -> str | None:
    """zh, en, de, fr by script and function words, others by their script; None where there is too little to tell."""
    s = _NOISE.sub(" ", text) if "@" in text or "＠" in text or ".txt" in text or "http" in text else text
    if _OTHER_SCRIPT.search(s):
        n = len(_LETTER.findall(s))
        for name, script in _SCRIPTS.items():
            if (own := len(script.findall(s))) >= 4 and own >= (0.2 if name == "ja" else 0.5) * n:
                return name
    han = sum(map(len, _HAN_RUNS.findall(s)))
    words = _WORD.findall(s.lower().replace("'", " ").replace("’", " "))
    heard = [w for w in words if w in _ANY_WORD]
    score = {k: sum([w in known for w in heard]) for k, known in WORDS.items()}
    best = max(score, key=score.get)
    if han and han >= 1.5 * score[best] and (han >= 4 or han >= len(words)) and score[best] < 4 + han / 12:
        return "zh"
    second = max(v for k, v in score.items() if k != best)
    return best if score[best] > second else None


def is_other_language(question: str, answer: str) -> bool:
    a = language(answer)
    if a is None:
        return False
    asked = _ASKED.search(question) if any(w in question for w in ("文", "语", "nglis", "erman", "rench", "hines", "eutsch", "ranzös", "nglais", "llemand", "rançais", "hinois")) else None
    if asked and _LANGUAGE[next(g for g in asked.groups() if g)] == a:
        return False
    q = language(question[: asked.start()] + question[asked.end() :] if asked else question)
    if q is None or q == a:
        return False
    return True


_TOKEN = re.compile(r"```|\*\*|</?[A-Za-z][^<>\n]*>|\n|[" + re.escape("".join(_PAIRS) + "".join(_CLOSERS) + "„") + "]")
_VOID = re.compile(r"</?(?:br|hr|img|input|meta|link|wbr|col)\b|<[^>]*/>$", re.I)
_MARKER = re.compile(r"[ \t]*(?:[-*+•·]|\(?\d{1,3}[.)、）]|[一二三四五六七八九十]+、)[ \t]*$")
_CUT_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}$|</$")


def parse(text: str) -> tuple[list[str], int]:
    """Pushdown parse: the structures still open where the text ends, outermost first, and where the one that its last character closes began (-1: none).

    Structures are fences (within which nothing else counts), emphasis, tags, brackets and quotations; and of the last line a list item without
    content, a table row with fewer cells than the row above, and a tag cut off.  A closing sign ends what was opened last with its own
    sign, and all that was opened after it; one that nothing opened is ignored.
    """
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    closed = -1

    def shut(kind: str, end: int) -> None:
        nonlocal closed
        while stack:
            top, at = stack.pop()
            count[top] -= 1
            if top == kind:
                closed = at if end == len(text) else closed
                return

    def enter(kind: str, at: int) -> None:
        stack.append((kind, at))
        count[kind] = count.get(kind, 0) + 1

    for m in _TOKEN.finditer(text):
        t, a = m.group(), m.start()
        if t == "```":
            if count.get(t):
                shut(t, m.end())
            elif a == 0 or text[a - 1] == "\n":
                enter(t, a)
        elif count.get("```") or t == "\n":
            continue
        elif t == "**":
            shut(t, m.end()) if count.get(t) else enter(t, a)
        elif t[0] == "<" and len(t) > 1:
            name = "<" + re.match(r"</?(\w+)", t)[1].lower()
            if _VOID.match(t):
                continue
            if t[1] != "/":
                enter(name, a)
            elif count.get(name):
                shut(name, m.end())
        elif t in _CLOSERS and count.get(_CLOSERS[t]):
            shut(_CLOSERS[t], m.end())
        elif (t in _PAIRS or t == "„") and not (t == "‘" and a and text[a - 1].isalnum()):
            enter(t, a)
    open_ = [k for k, _ in stack]
    if not count.get("```"):
        lines = text.split("\n")
        if len(lines) > 1 and _MARKER.match(lines[-1]):
            open_.append("item")
        if lines[-1].lstrip().startswith("|") and len(lines) > 1 and lines[-2].lstrip().startswith("|") and lines[-1].count("|") < lines[-2].count("|"):
            open_.append("row")
        if _CUT_TAG.search(lines[-1]):
            open_.append("tag")
    return open_, closed


def ends_sentence(text: str, closed: int | None = None) -> bool:
    """Ends a sentence; closing quotes and brackets, or a remark in brackets, may follow.  ``closed``: of a text parsed already, where what its last sign closes began."""
    s = _body(text)
    if _DOTS.search(s):
        return False
    while s := s.rstrip():
        if s[-1] in _END:
            return not (s[-1] == "." and len(s) > 1 and s[-2].isdigit() and len(_HAN.findall(s[-30:])) > 5)
        if s[-1] in _CLOSERS:  # a quotation or remark that is complete may close the text
            return (parse(s)[1] if closed is None else closed) >= 0 or s[:-1].rstrip()[-1:] in tuple(_END)
        if s[-1] not in "\"'’›*`" and not s.endswith(">"):
            return False
        s = re.sub(r"<[^<>]*>$|.$", "", s, flags=re.S)
    return False


def is_truncated(answer: str) -> bool:
    s = _body(answer)
    title = _title(s)
    if title and _CONCLUSION.search(s, title.end()):
        notes = None
        for notes in _NOTES.finditer(s, title.end()):
            pass
        if notes is None:
            return True
        line = s.rpartition("\n")[2] if "\n" in s[notes.end() :] else ""
        return not (_ITEM.match(line) and ends_sentence(line))
    if len(s.strip()) <= SHORT and not _DOTS.search(s):
        return False
    if len(s.strip()) <= SHORT:
        return len(letters(s)) > 0 and len(s.strip()) > 6
    open_, _ = parse(s)
    return bool(open_) or not ends_sentence(s)


def defect(question: str | None, answer: str | None, hit: bool | None) -> str | None:
    """The kind of defect of a pair, None where it has none."""
    if not question or not _LETTER.search(question):
        return None
    if answer is None or not answer.strip():
        return "empty"
    original = garble.repair(answer)
    lost = original is not None and bool(garble._may_be_garbled(original))
    q, a = forms.consistent(question), forms.consistent(original or answer)
    if is_empty(a):
        return None if lost else "empty"
    if is_copied(q, a):
        return "copied"
    if hit and is_refusal(a):
        return "refusal"
    if not lost and is_other_language(q, a):
        return "other_language"
    if not lost and is_truncated(a) and not (original is not None and ends_sentence(a)):
        return "truncated"
    return None


@F.pandas_udf(T.StringType())
def _defect(question: pd.Series, answer: pd.Series, hit: pd.Series) -> pd.Series:
    return pd.Series([defect(q, a, h) for q, a, h in zip(question, answer, hit.fillna(False))], dtype=object)


def pair_defect(question: Column, answer: Column, hit: Column) -> Column:
    return _defect(question, answer, F.coalesce(hit, F.lit(False)))


def broken_pairs(df: DataFrame, question: str, answer: str, hit: str, out: str = "defect") -> DataFrame:
    """The defective rows of ``df`` with the column ``out``: one of ``DEFECTS``; repeated rows stay repeated."""
    return df.withColumn(out, pair_defect(F.col(question), F.col(answer), F.col(hit))).where(F.col(out).isNotNull())

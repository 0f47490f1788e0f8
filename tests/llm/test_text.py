"""Garbled, disguised, defective and personal texts: small cases, and the operators on awkward tables."""

import pytest
from pyspark.sql import functions as F

from fathom.llm import forms, garble, pairs, privacy

ZH = "门店反馈称，颈部的厚度读数平均持续七周，剩余部分不得回装。"
DE = "Für die Fläche gilt: Süßholz löst sich in Lösung, Größe mäßig."


@pytest.mark.parametrize("true,wrong", [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("gbk", "latin-1"), ("gbk", "big5"), ("utf-8", "gbk")])
def test_repair_chinese(true, wrong):
    raw = ZH.encode(true)
    text = raw.decode(wrong, "ignore")
    out = garble.repair(text)
    assert out is not None and garble.is_garbled(text)
    if raw.decode(wrong, "replace").encode(wrong, "replace") == raw:
        assert out == ZH


@pytest.mark.parametrize("true,wrong", [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("latin-1", "cp850"), ("latin-1", "cp437"), ("utf-8", "mac_roman")])
def test_repair_western(true, wrong):
    assert garble.repair(DE.encode(true).decode(wrong)) == DE


def test_repair_twice_garbled_and_mixed():
    once = ZH.encode().decode("latin-1")
    assert garble.repair(once.encode().decode("latin-1")) == ZH
    mixed = "正常的文字，" + "外盒".encode().decode("latin-1") + "完好。"
    assert garble.repair(mixed) == "正常的文字，外盒完好。"


@pytest.mark.parametrize("text", ["", "plain", ZH, DE, "NÃO AGITAR", "São Tomé", "Не взбалтывать", "NAÏF, à 5 °C", "Âge d’Or™", "真的？？？好用???", "①②③ 25 μm, 3 cm² ®", "👩\u200d⚕\ufe0f ok", "瑗芮晞霁", "leaﬂet", "Моlаvе"])
def test_ordinary_text_is_not_garbled(text):
    assert garble.repair(text) is None and not garble.is_garbled(text)


@pytest.mark.parametrize(
    "text",
    ["これは普通の日本語の文章です。カタカナも含みます。", "한국어 텍스트는 정상입니다. 설명서를 참조하십시오.", "繁體中文說明書請參閱第三頁", "「東京都」ｱｲｳ", "5 µg/ml neben Müller™", "Größe 5 µm, Müller", "Señor Núñez, Åse Øster, Łódź, Dvořák", "Ünal Çelik İstanbul", "Ελληνικά γράμματα", "ein m³, 20 °C ±2, §5"],
)
def test_other_languages_are_left_alone(text):
    assert garble.repair(text) is None and not garble.is_garbled(text)


def test_only_matched_spans_are_replaced():
    assert garble.repair("fŸr dich, schšn, Café") == "für dich, schön, Café"
    assert garble.repair("5 µg neben " + "Größe".encode().decode("latin-1")) == "5 µg neben Größe"
    text = "这里是 café、Ærø、Łódź 与 " + "外盒完好".encode().decode("cp1252", "ignore") + "。"
    fixed = garble.repair(text)
    assert fixed.startswith("这里是 café、Ærø、Łódź 与 ") and fixed.endswith("。")
    for _ in range(6):  # garbled many times
        text = "外盒完好".encode().decode("latin-1") if _ == 0 else text.encode().decode("latin-1")
    assert garble.repair(text) == "外盒完好"


def test_the_automaton_finds(monkeypatch):
    garbled = "外盒".encode().decode("latin-1")
    assert garble.is_garbled("正常的文字，" + garbled)
    empty = garble.automaton().__class__()
    empty.add_word("\x00", (1, ()))
    empty.make_automaton()
    monkeypatch.setattr(garble, "automaton", lambda: empty)
    assert garble._by_sequences("正常的文字，" + garbled) is None


def test_western_letters_as_double_bytes():
    assert garble.repair(DE.encode().decode("gbk", "ignore")) is not None
    assert garble.repair("rapport 脿 la version") == "rapport à la version"
    assert garble.repair("苒霁翎 Deleth Filler is fine for people") is None


def test_lost_characters_are_a_case():
    assert garble.is_garbled("abc\ufffddef") and garble.is_garbled("锟斤拷")


@pytest.mark.parametrize("text,form", [("ｔｅｓｔ１", "test1"), ("a\u00a0b", "a b"), ("a\u3000b", "a b"), ("a\u200bb", "ab"), ("cafe\u0301", "café"), ("Моlave", "Molave"), ("⼈中", "人中"), ("ﬁn", "fin"), ("a\u00adb", "ab")])
def test_disguises(text, form):
    assert forms.disguised(text) and forms.consistent(text) == form


@pytest.mark.parametrize("text", ["，。！", "①", "cm²", "™", "👩\u200d⚕\ufe0f", "α-arbutin", "25 μm", "Не взбалтывать", "café", "“quoted”", "a\nb", ""])
def test_ordinary_forms(text):
    assert not forms.disguised(text) and forms.consistent(text) == text


@pytest.mark.parametrize("text,form", [("ρaypal", "paypal"), ("Ꭺpple", "Apple"), ("Օne", "One"), ("ꓐook", "Book"), ("Ⲥat", "Cat"), ("Мо\u200blаve", "Molave")])
def test_letters_of_many_scripts(text, form):
    assert forms.disguised(text) and forms.consistent(text) == form and forms.skeleton(text) == forms.skeleton(form)


@pytest.mark.parametrize("text", ["Հայերեն", "ışık", "NFκB", "Ελληνικά", "ᎠᎡᎢ"])
def test_words_of_other_scripts_are_ordinary(text):
    assert not forms.disguised(text) and forms.consistent(text) == text


def test_skeleton_decides(monkeypatch):
    """A text is disguised only where the skeleton changes it."""
    texts = ["ｔｅｓｔ１", "a\u00a0b", "a\u200bb", "cafe\u0301", "Моlave", "⼈中", "ﬁn"]
    for t in texts:
        spots = list(forms.changes(t))
        assert spots and all(forms.skeleton(t[:a] + t[b:]) != forms.skeleton(t[:a] + "Q" + t[b:]) for a, b in spots)
        assert all(t[a:b] in forms.prototypes() or t[a:b] == "\u0301" for a, b in spots)
    monkeypatch.setattr(forms, "changes", lambda text: iter(()))
    assert not any(map(forms.disguised, texts))


def test_prototypes_from_a_file_of_confusables():
    more = forms.more_prototypes(["# comment", "0405 ;\t0053 ;\tMA", "A731 ; 0073 ; MA # note", ""])
    assert more == {"\u0405": "S", "\ua731": "s"} and forms.skeleton("\ua731x", more) == "sx"


def test_skeleton_of_numbers_and_plain_letters():
    assert forms.skeleton("Il1") == forms.skeleton("lII") and forms.skeleton("O0") == forms.skeleton("00") and forms.skeleton("m") == forms.skeleton("rn")


def test_skeleton_joins_look_alikes():
    assert forms.skeleton("Ηａｎd ﬁ") == forms.skeleton("Hand fi")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, None, None), (2, "", "", True), (3, "x" * 200_000, "ａ" * 50_000, None), (4, "Q?", "A.", False), (4, "Q?", "A.", False), (None, "q", "a", True)]
    return spark.createDataFrame(rows, "id bigint, q string, a string, hit boolean").selectExpr("*", "q as form", "q as original", "id as text", "q as _t", "hit as defect")


def test_awkward_tables(awkward):
    assert forms.unify(awkward, "a").count() == 6
    assert forms.look_alike_groups(awkward, "id", "a").where("group_size > 1").count() == 2
    assert garble.repair_text(awkward, "a", "fixed").where("fixed is not null").count() == 0
    assert pairs.broken_pairs(awkward, "q", "a", "hit").count() >= 1
    assert privacy.find(awkward, "id", ["q", "a"]).count() == 0
    assert privacy.redact(awkward, "id", ["q", "a"]).count() == 6
    none = awkward.where("false")
    assert forms.unify(none, "a").isEmpty() and garble.repair_text(none, "a").isEmpty() and pairs.broken_pairs(none, "q", "a", "hit").isEmpty() and privacy.find(none, "id", ["q", "a"]).isEmpty()


CASES = [
    ("怎么用？", None, True, "empty"),
    ("怎么用？", " 【】 ", True, "empty"),
    ("怎么用？", "N/A", True, "empty"),
    ("怎么用？", "用量说明（资料提取）：\n结论：", True, "empty"),
    ("怎么用？", "门店反馈称，颈部的厚度读数平均持续七周，剩余部", True, "truncated"),
    ("怎么用？", "门店反馈称，颈部的厚度读数平均持续七周，剩余部分……", True, "truncated"),
    ("怎么用？", "用量说明（资料提取）：\n结论：\n- 每日一次。\n注意事项：\n- 个体差异", True, "truncated"),
    ("怎么用？", "用量说明（资料提取）：\n结论：\n- 每日一次。\n注意事项：\n- 个体差异较大。", True, None),
    ("怎么用？", "门店反馈称，颈部的厚度读数平均持续七周。（见随附说明书第79页）", True, None),
    ("怎么用？", "每日一次", True, None),
    ("怎么用？", "抱歉，我不能回答这个问题。", True, "refusal"),
    ("怎么用？", "抱歉，我不能回答这个问题。", False, None),
    ("怎么用？", "抱歉让您久等，每日两次，每次三毫升即可，动作要慢、力道要匀。", True, None),
    ("Can I shower?", "I'm sorry, but I can't help with that.\nHave a nice day.", True, "refusal"),
    ("三天后能洗澡吗", "您问的是：“三天后能洗澡吗”", True, "copied"),
    ("三天后能洗澡吗", "三天后能洗澡吗 三天后能洗澡吗", True, "copied"),
    ("三天后能洗澡吗", "您问的是“三天后能洗澡吗”，多数情况下两天以后就可以正常洗澡。", True, None),
    ("三天后能洗澡吗", "According to the leaflet, the cleaning step is reviewed after 9 weeks.", True, "other_language"),
    ("请用英文回答：三天后能洗澡吗", "According to the leaflet, the cleaning step is reviewed after 9 weeks.", True, None),
    ("How often do I repeat it?", "每三周一次，动作要慢、力道要匀，防晒从第三天开始补。", True, "other_language"),
    (None, None, True, None),
    ("  ", "", True, None),
]


@pytest.mark.parametrize("question,answer,hit,kind", CASES)
def test_defects(question, answer, hit, kind):
    assert pairs.defect(question, answer, hit) == kind


def test_pushdown_parser():
    assert pairs.parse("a (b [c] d)") == ([], 2)
    assert pairs.parse("a “b") == (["“"], -1)
    assert pairs.parse("```\n(\n```") == ([], 0)
    assert pairs.parse("```\n(")[0] == ["```"]
    assert pairs.parse("([{)") == ([], 0)  # a closing sign ends what was opened after its own
    assert pairs.parse("a) b]")[0] == []
    assert pairs.parse("<b>x <br> <i>y</i>")[0] == ["<b"]
    assert pairs.parse("„a“ «b» ‘c’")[0] == []
    assert pairs.parse("(" * 60 + ")" * 60) == ([], 0)
    assert pairs.parse("“" * 20_000 + "]" * 20_000)[0] == ["“"] * 20_000


CUT = [
    "请参考说明书（第三页，避免阳光直射，动作要慢、力道要匀。",
    "说明书写道：“避免阳光直射，动作要慢、力道要匀。",
    "请**避免阳光直射，动作要慢、力道要匀，防晒从第三天开始补。",
    "步骤如下，请按顺序进行，每步之间休息：\n1. 清洁面部。\n2.",
    "各档用量如下表所示，请对照使用：\n| 部位 | 用量 |\n| --- | --- |\n| 面颊。",
    "Please read <b>the whole leaflet before the first use.",
    "Please read the whole leaflet before the first use. <a hre",
    "请按下面的配置进行设置，再重新启动设备。\n```\nx = 1。",
]


@pytest.mark.parametrize("text", CUT)
def test_open_structures_are_truncated(text, monkeypatch):
    assert pairs.defect("怎么用？" if pairs._HAN.search(text) else "How?", text, True) == "truncated"
    monkeypatch.setattr(pairs, "parse", lambda s: ([], -1))
    assert not pairs.is_truncated(text) or not pairs.ends_sentence(text)  # the stack alone finds those that end a sentence


@pytest.mark.parametrize("text", ["请参考说明书（第三页），避免阳光直射，动作要慢。", "说明书写道：“避免阳光直射，动作要慢、力道要匀。”", "It's the patients' choice, isn't it? Don't rush the first visit.", "步骤如下，请按顺序进行：\n1. 清洁面部。\n2. 涂抹凝胶。", "请按 **说明** 使用，避免阳光直射，动作要慢。", "5 < 6 且 7 > 3，动作要慢、力道要匀，防晒从第三天开始补。"])
def test_closed_structures_are_whole(text):
    assert not pairs.is_truncated(text)


def test_tiling_marks_what_it_used():
    assert pairs.tiling("abcdXabcd", "zabcdz") == 8  # the question twice
    assert pairs.tiling("abcdefghXabcd", "abcdefghij") == 12
    assert pairs.tiling("efghabcd", "abcdefgh") == 8  # another order
    assert pairs.tiling("abcXabc", "abc") == 0
    assert pairs.is_copied("三天后能洗澡吗请告诉我", "请告诉我三天后能洗澡吗")


@pytest.mark.parametrize("answer,name", [("三日後にはシャワーを浴びることができます。", "ja"), ("사흘 뒤에는 샤워하실 수 있습니다.", "ko"), ("Через три дня можно принимать душ.", "ru"), ("Μετά από τρεις ημέρες μπορείτε.", "el")])
def test_other_scripts(answer, name):
    assert pairs.language(answer) == name and pairs.defect("三天后能洗澡吗", answer, True) == "other_language"


FOUND = [
    ("邮箱ke.lin@m.tarn.example", {"email"}),
    ("sun.yan (at) inbox (dot) test收资料", {"email"}),
    ("49738625#Corvane.example（#换成@）", {"email"}),
    ("@Veeth官方 said so", set()),
    ("手机142-2277-2210", {"phone"}),
    ("电话一五四零九八二一七八三", {"phone"}),
    ("Tel. +49 30 23125 094", {"phone"}),
    ("das Paket geht an Am Kiefernhang 283", {"address"}),
    ("am Tag 17, Betrag 20", set()),
    ("(0888)55503963随时可打", {"phone"}),
    ("热线400-704-1898已打过, 800-967-4872, 0800-7661635", set()),
    ("订单19875058673还没到", set()),
    ("身份证号 953235 19981008 037X", {"id_number"}),
    ("批号924869195607283454", set()),
    ("passport no. X7166400", {"id_number"}),
    ("护照号K94238962", {"id_number"}),
    ("样品寄到云泽市青栾区松针巷58号5单元", {"address"}),
    ("我在霁月公寓2幢2单元2202", {"address"}),
    ("望梧路那家店还在吗", set()),
    ("I live at 163 Tarnwick Avenue", {"address"}),
    ("wohnhaft Quellrainweg 108a", {"address"}),
    ("envoi au 268 chemin de la Brèzière", {"address"}),
    ("covers about 20 square cm. During 17 weeks", set()),
    ("我叫褚若诚，李女士也问过", {"person_name"}),
    ("this is Quillsby, Greer, call", {"person_name"}),
    ("Dr. Hartlow said so. Delsoso Filler", set()),
    ("hier Eike Buchenau, Mail", {"person_name"}),
    ("hier Frau Buchenau, Mail", set()),
]


@pytest.mark.parametrize("text,kinds", FOUND)
def test_personal_data(text, kinds):
    assert {k for _, _, k in privacy.Knowledge().of(text)} == kinds


def test_spans_point_into_the_disguised_text():
    text = "手机１42-22\u200b77-2210，"
    ((a, b, k),) = privacy.Knowledge().of(text)
    assert k == "phone" and text[a:b] == "１42-22\u200b77-2210"


NAMES = [f + g for f in "赵钱孙李周吴郑王冯陈" for g in ("晓静", "立", "宁雅", "桐", "明", "子涵", "文博", "芳")]
CARRIED = [("顾问", "接待"), ("由", "护士跟进"), ("昨天约了", "来店里")]


def log_of_names(spark, held=True):
    """Texts with names in three sentences, half of them beside a phone number, and texts without."""
    rows = [f"{a}{n}{b}，其余照旧" + (f"，电话1391234{i:02d}{j:02d}" if held and i % 2 else "") for j, (a, b) in enumerate(CARRIED) for i, n in enumerate(NAMES)]
    rows += ["王者风范接待，其余照旧", "方法好，方便得很", "请在温水中化开"] * 300 + ["电话400-704-1898已打过"] * 20
    return rows, spark.createDataFrame(list(enumerate(rows)), "id bigint, q string").repartition(3)


@pytest.mark.parametrize("most", [10**6, 0])
def test_names_are_learned_and_the_rest_is_kept(spark, monkeypatch, most):
    monkeypatch.setattr(privacy, "MOST_KEYS", most)  # sent to the tasks, or joined to the texts
    rows, df = log_of_names(spark)
    clean = {r["id"]: r["text"] for r in privacy.redact(df, "id", ["q"], seeds=False).collect()}
    for i, text in enumerate(rows):
        want = text
        for a, b in CARRIED:
            for n in NAMES:
                want = want.replace(f"{a}{n}{b}", f"{a}[PERSON_NAME]{b}")
        want = privacy.re.sub(r"1391234\d{4}", "[PHONE]", want)
        assert clean[i] == want


def test_names_need_co_occurrence(spark):
    _, df = log_of_names(spark, held=False)
    assert privacy.find(df, "id", ["q"], seeds=False).where("pii_type = 'person_name'").isEmpty()


LONG = [
    ("上个星期六下午我们在新开的那家分店里面见到了", "并且约好了下一次过来复查的日期"),
    ("去年冬天在城里那家最早开门的店里第一次做完以后一直没有再去过直到上个月底才又重新约了", "来看一下恢复得怎么样再决定下一步是不是需要继续做下去或者先停一段日子看看再说"),
]


@pytest.mark.parametrize("most", [10**6, 0])
def test_names_in_clauses_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(privacy, "MOST_KEYS", most)
    rows = [f"{a}{n}{b}" + ("，电话13912345678" if i % 2 else "") for a, b in LONG for i, n in enumerate(NAMES)] + ["请在温水中化开"] * 300
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, q string")
    clean = {r["id"]: r["text"] for r in privacy.redact(df, "id", ["q"], seeds=False).collect()}
    assert [clean[i] for i in range(len(rows))] == [f"{a}[PERSON_NAME]{b}" + ("，电话[PHONE]" if i % 2 else "") for a, b in LONG for i, n in enumerate(NAMES)] + rows[-300:]
    assert privacy.find(df, "id", ["q"], seeds=False).where("pii_type = 'person_name'").count() == len(LONG) * len(NAMES)


def test_frames_of_a_long_clause_stay_short():
    found = list(privacy.frames_of("看" * 20_000 + "张小静" + "看" * 20_000))
    assert [t for _, t in found] == ["张小", "张小静"] and all(len(f) <= 4 * privacy.SIDE + 1 for f, _ in found)
    assert len({f for n in ("张小静", "王晓立") for f, _ in privacy.frames_of("看" * 50 + n + "看" * 50)}) == 3  # the sides alone count
    assert not {f for f, _ in found} & {f for f, _ in privacy.frames_of("看" * 20_001 + "张小静" + "看" * 20_000)}
    assert list(privacy.frames_of("张小静")) == [("□静", "张小")]


def test_grammars_without_digits():
    import re

    for g in privacy._GRAMMARS:
        if g not in privacy._WITHOUT_DIGITS:
            assert not any(g[2].search(re.sub(r"\d", "x", t)) for t, _ in FOUND), g[0]
    assert [k for _, _, k in sorted(privacy.entities("电话一五四零九八二一七八三，住松针巷五十八号，ke.lin@mail.com")[0])] == ["phone", "address", "email"]


def test_western_names_by_information(spark):
    first, last = "Alder Greer Orson Linnea Perrin Marlo".split(), "Hartlow Quillsby Ashcombe Drewitt Fallowby".split()
    rows = [f"The chair by the door is for {a} {b}, call 212-555-01{i}{j}" for i, a in enumerate(first) for j, b in enumerate(last)]
    rows += [f"We saw {a} {b} yesterday" for a, b in (("Alder", "Drewitt"), ("Marlo", "Ashcombe"))]
    rows += [f"Batch {i} holds Delsoso Filler and Moanla Eye from Orlinn Biologics" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, q string")
    found = {r["id"] for r in privacy.find(df, "id", ["q"], seeds=False).where("pii_type = 'person_name'").collect()}
    assert found == set(range(32))


@pytest.mark.parametrize("number", range(4))
def test_hints_are_in_whatever_declines(number):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    hints, grammar = pairs._REFUSALS[number]

    @settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(privacy.re.compile(grammar.pattern)))
    def check(text):
        assert any(h in text.lower() for h in hints)

    check()


def test_declines_without_a_particle():
    assert pairs.defect("三天后能洗澡吗", "抱歉，这超出我可以处理范围。", True) == "refusal"


def test_copies_are_told_apart_early(monkeypatch):
    import random

    rng = random.Random(5)
    question = "三天后能洗澡吗请告诉我要不要先等伤口长好"
    texts = []
    for _ in range(400):
        lead = "".join(rng.sample("您好刚才问的是以下内容对不起这个需要先确认一下再说", rng.randrange(14)))
        texts.append(rng.choice(["", "Sie fragten: "]) + lead + question[: rng.randrange(12, 21)] + rng.choice(["", "？", question]))
    early = [pairs.is_copied(question, t) for t in texts]
    monkeypatch.setattr(pairs, "_HAN_LETTERS", privacy.re.compile("(?!)"))
    assert early == [pairs.is_copied(question, t) for t in texts] and 40 < sum(early) < 360


@pytest.mark.parametrize("number", range(7))
def test_pre_tests_hold_for_whatever_the_grammar_matches(number):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    _, needed, pattern = privacy._GRAMMARS[number]

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(text):
        if pattern.search(text):
            assert needed(text, privacy._NUMBER.search(text))

    check()


def test_disguised_mail():
    assert all({k for _, _, k in privacy.Knowledge().of(t)} == {"email"} for t in ("ke.lin（AT）mail.com", "ke.lin【AT】mail.com", "ke.lin ( at ) mail.com"))


def test_garbled_column(spark):
    df = spark.createDataFrame([(ZH.encode().decode("latin-1"),), (ZH,), (None,)], "t string")
    assert [r[0] for r in df.select(garble.garbled(F.col("t"))).collect()] == [True, False, False]


def test_rare_family_names(spark):
    for text in ("我叫曾小明", "联系人肖燕", "本人闫伟", "姓名谭嘉琪"):
        assert [k for _, _, k in privacy.Knowledge().of(text)] == ["person_name"], text

"""Text expressions against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import text as X
from fathom.operators import chunk

TEXT = st.text(alphabet="ab中　 \t\n\r-=_：；。x1", max_size=60)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, texts, *columns):
    return [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*columns).collect()]


@FEW
@given(st.lists(TEXT, min_size=5, max_size=25))
def test_lines_and_unique(spark, texts):
    got = one(spark, texts, X.lines(F.col("t")), X.unique(F.split("t", "\n")), X.utrim(F.col("t")))
    for t, (lines, unique, trimmed) in zip(texts, got):
        lf = t.replace("\r\n", "\n").replace("\r", "\n")
        clean = [" ".join(x.split()) for x in lf.split("\n")]
        assert lines == [x for x in clean if x and not set(x) <= set("-=_ ")]
        assert unique == list(dict.fromkeys(y for x in t.split("\n") if (y := " ".join(x.split()))))
        assert trimmed == t.strip()


def loop_windows(t, size, overlap):
    out, i = [], 0
    while i < len(t):
        if p := t[i : i + size].strip():
            out.append(p)
        if i + size >= len(t):
            break
        i += size - overlap
    return out


@FEW
@given(st.lists(TEXT, min_size=3, max_size=10))
def test_fixed_windows(spark, texts):
    texts += ["", "a" * 7, "a" * 10, "a" * 11, "a" * 17, "a" * 18]
    got = one(spark, texts, chunk.fixed_windows(F.col("t"), 10, 3))
    for t, (windows,) in zip(texts, got):
        assert windows == loop_windows(t.replace("\r\n", "\n").replace("\r", "\n"), 10, 3)


def test_windows_of_reference_sizes(spark):
    texts = ["x" * n for n in (0, 1, 600, 601, 1120, 1121)] + [None]
    got = [w for (w,) in one(spark, texts, chunk.fixed_windows(F.col("t")))]
    assert [[len(x) for x in w] for w in got] == [[], [1], [600], [600, 81], [600, 600], [600, 600, 81], []]


def section(t, titles, stops):
    starts = [p for x in titles if (p := t.find(x)) >= 0]
    if not starts:
        return ""
    rest = t[min(starts) :]
    ends = [p for x in stops if (p := rest.find(x)) > 0]
    return rest[: min(ends)].strip() if ends else rest.strip()


@FEW
@given(st.lists(st.text(alphabet="abxy \n", max_size=40), min_size=5, max_size=20))
def test_section(spark, texts):
    texts += ["ya b a", "b", ""]
    got = one(spark, texts, X.section(F.col("t"), ["a", "xx"], ["b", "a"]))
    for t, (s,) in zip(texts, got):
        assert s == section(t, ["a", "xx"], ["b", "a"])


def test_split_questions(spark):
    got = one(spark, ["a；b。 a ；。c，另外d", None, "  ", "x"], X.split_questions(F.col("t"), ["；", "。", "，另外"]))
    assert [g[0] for g in got] == [["a", "b", "c", "d"], [], [], ["x"]]


def test_contains_any_quotes_words(spark):
    got = one(spark, ["a.c", "abc", None, "x\\Ey"], X.contains_any(F.col("t"), ["a.c", "\\E"]))
    assert [g[0] for g in got] == [True, False, False, True]


def test_packing(spark):
    (got,) = one(spark, ["# T\na\nb\n\n\nc\n1) d\ne"], chunk.paragraphs(F.col("t")))
    assert got[0] == ["# T", "a\nb", "c", "1) d", "e"]

    def pack(*parts):
        return spark.createDataFrame([(list(parts),)], "p array<string>").select(chunk.pack_paragraphs(F.col("p"))).first()[0]

    assert pack() == []
    assert pack("a" * 200, "b" * 200) == ["a" * 200 + "\n" + "b" * 200]
    assert pack("a" * 420, "b" * 300) == ["a" * 420, "a" * 100 + "\n" + "b" * 300]
    assert pack("a" * 420, "b" * 500) == ["a" * 420, "b" * 500]  # over 1.3 times the size with the overlap
    assert [len(w) for w in pack("x" * 505)] == [420, 185]
    assert pack("y" * 504) == ["y" * 504]
    assert pack("p" * 430, "p" * 430) == ["p" * 430, "p" * 100 + "\n" + "p" * 430]
    assert pack("q", "q" * 430, "q") == ["q", "q\n" + "q" * 430, "q" * 100 + "\nq"]
    assert pack("a  b", "c" * 600, "a b") == ["a  b", "c" * 420, "c" * 280]  # repeats up to white space count once
    assert one(spark, [None, "", " \n "], chunk.packed(F.col("t"))) == [([],), ([],), ([],)]


def test_titles(spark):
    texts = ["# a", "一、b", "【c】", "step 3", "12) d", "0.8mm", "===", "---", "第三", "#x"]
    assert all(r[0] for r in one(spark, texts, chunk.is_title(F.col("t"))))
    assert not any(r[0] for r in one(spark, ["a", "8mm", "a # b", "", "【c】d"], chunk.is_title(F.col("t"))))


def test_head_and_tail(spark):
    assert one(spark, ["a😀bc", "", None], X.head(F.col("t"), 2), X.tail(F.col("t"), 2)) == [("a😀", "bc"), ("", ""), (None, None)]

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from parleyspark.llm import lookalike as la

PIECES = st.lists(st.sampled_from(["a", "e", "é", "é", "о", "o", "ο", "Ａ", "A", "​", "­", " ", " ", "　", "\n", "\t", "й", "й", "ё", "ё", "ё", "ﬁ", "²", "́", "̣", "̇", "각", "ᄀ", "ᅡ", "ᆨ", "ｶ", "ﾞ", "ẋ̣", "Å", "Å", "🙂", "‍", "б"]), max_size=14).map("".join)


def whole(text):
    """The same form made of the whole text at once."""
    _, _, first, then = la._tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(first)).translate(then))


@settings(max_examples=600, deadline=None)
@given(PIECES)
def test_segments_give_what_the_whole_text_gives(text):
    got = la.canonical(text)
    assert got == whole(text) and la.canonical(got) == got


def test_forms():
    same = [("Ｔｅｓｔ", "Test"), ("café", "café"), ("раssроrt", "passport"), ("a b c", "a b c"), ("so­ft​", "soft"), ("Ζοο", "Zoo"), ("ё", "ë"), ("ｱ", "ア")]
    for a, b in same:
        assert la.canonical(a) == la.canonical(b)
    for a, b in (("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("a\tb", "a b"), ("ﬁ", "fi"), ("x²", "x2")):
        assert la.canonical(a) != la.canonical(b)
    assert la.canonical(None) is None and la.canonical("") == ""


def test_pairs(spark):
    rows = [(1, "Test one", 0), (2, "Ｔest one", 0), (3, "Test one", 0), (4, "Te​st one", 0), (5, None, 0), (6, "​", 0), (7, " ", 0), (8, " ", 0), (9, "test one", 0), (None, "Test one", 0), (10, "é" * 100_000, 0), (11, "é" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look int")
    got = {tuple(r) for r in la.look_alike_pairs(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (2, 3), (3, 4), (10, 11)}
    assert la.look_alike_pairs(df.where("false")).count() == 0
    t = {r["doc_id"]: r["changed"] for r in la.canonical_rows(df).collect()}
    assert t[1] is False and t[2] is True and t[5] is None and t[11] is True


def test_classes(spark):
    forms = ["".join(x if i >> k & 1 else y for k, (x, y) in enumerate(zip("оасерхуіј", "oacepxyij"))) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*forms, "alone", "alone", None, " "])], "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in la.look_alike_classes(df).collect()}
    assert len(got) == 402 and all(got[i] == (0, i, 400, 399) for i in range(400)) and got[400] == got[401] == (400, 400, 1, 0)
    assert la.look_alike_classes(df.where("false")).count() == 0

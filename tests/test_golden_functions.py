"""Hand-derived cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from sentiloom.functions import arrays as A
from sentiloom.functions import prompts as P
from sentiloom.functions import responses as R
from sentiloom.functions import text as X
from sentiloom.operators import shape as S


@pytest.mark.parametrize(
    "text, marked",
    [
        (
            "The camera is not very good, but the screen is extremely bright.",
            "The camera is not very INTENSIFIED_NOT_good , but the screen is extremely INTENSIFIED_bright .",
        ),
        ("not , good", "not NOT_, good"),
        ("never not", "never not"),
        ("very not", "very not"),
        ("NO way, it's Hardly 5", "NO NOT_way , it's Hardly NOT_5"),
        ("good", "good"),
        ("", ""),
        ("a not b very c", "a not NOT_b very INTENSIFIED_c"),
    ],
)
def test_mark_modifiers(one, text, marked):
    assert one(X.mark_modifiers("t"), t=text) == marked


def test_mark_modifiers_long_run(one):
    text = "no " * 20_000 + "end"
    assert one(X.mark_modifiers("t"), t=text) == "no " * 20_000 + "NOT_end"


def test_apostrophe_chain_does_not_overflow(one):
    text = "a" + "'a" * 50_000
    assert one(X.surface_tokens("t"), t=text) == [text]


@pytest.mark.parametrize(
    "ids, aspect, mask",
    [
        ([5, 1, 2, 9, 1, 2, 1], [1, 2], [0, 1, 1, 0, 1, 1, 0]),
        ([1, 1, 1], [1, 1], [1, 1, 1]),
        ([3], [7, 8], [0]),
        ([1, 2], [], [0, 0]),
        ([1], [1, 2], [0]),
        ([101, 9573, 2051, 2003, 102], [9573, 2051], [0, 1, 1, 0, 0]),
        ([], [1], []),
        ([1, 2, 1, 2, 1], [1, 2, 1], [1, 1, 1, 1, 1]),
        ([4, 1, 2, 3], [1, 2, 3], [0, 1, 1, 1]),
    ],
)
def test_aspect_mask(one, ids, aspect, mask):
    assert one(A.aspect_mask("ids", "a"), ids=ids, a=aspect) == mask


def test_padding(one):
    assert one(A.pad("ids", F.lit(4)), ids=[7, 8]) == [7, 8, 0, 0]
    assert one(A.attention("ids", F.lit(4)), ids=[7, 8]) == [1, 1, 0, 0]


@pytest.mark.parametrize(
    "value, terms", [("x", ["x"]), ('["a","b"]', ["a", "b"]), ("NONE", ["NONE"]), (None, None), ("[x", ["[x"])]
)
def test_as_list(one, value, terms):
    assert one(R.as_list("v"), v=value) == terms


@pytest.mark.parametrize(
    "response, terms, reason",
    [
        ("Sure:\n[{'aspectTerm': \"it's fine\"}]", ["it's fine"], None),
        ("not json", None, "no array"),
        ("[{'aspectTerm': 'x'}] trailing", None, "no array"),
        ("[oops]", None, "not json"),
        ("[]", [], "empty array"),
        ('[{"aspectTerm": "a"}, "junk", {"aspectTerm": ["b", "c"]}]', ["a", None, '["b","c"]'], "entry is not an object"),
        (None, None, "no array"),
    ],
)
def test_parse_response(one, response, terms, reason):
    assert one(R.parse("r", R.ASPECT_ENTRY)["aspectTerm"], r=response) == terms
    assert one(R.reject_reason("r"), r=response) == reason


@pytest.mark.parametrize(
    "value, flag", [("True", True), ("false", False), ("1", True), ("off", False), ("maybe", None), (None, None)]
)
def test_parse_bool(one, value, flag):
    assert one(R.parse_bool("v"), v=value) is flag
    assert (one(R.bool_reject("v"), v=value) is None) == (flag is not None)


@pytest.mark.parametrize("answer, code", [("</s>neutral<pad>", 2), ("Great", 0), (" negative ", 1), ("Negative", 0), (None, 0)])
def test_decode_exact(one, answer, code):
    assert one(R.decode_exact("a"), a=answer) == code


@pytest.mark.parametrize("answer, code", [("It is Negative.", 1), ("neutral or positive", 0), ("unsure", 2)])
def test_decode_contains(one, answer, code):
    assert one(R.decode_contains("a"), a=answer) == code


def test_label_names(one):
    assert [one(R.label_name("c"), c=c) for c in (0, 1, 2, 3)] == ["positive", "negative", "neutral", None]
    assert [one(R.label_code("c"), c=c) for c in ("neutral", "bad")] == [2, None]


def test_prompts(one):
    context, prompt = P.aspect("c", "t")
    assert one(context, c="c", t="t") == 'Given the sentence "c", '
    assert one(prompt, c="c", t="t") == 'Given the sentence "c", which specific aspect of t is possibly mentioned?'
    assert one(P.opinion("c", "t", "a")[0], c="c", t="t", a="a") == "c The mentioned aspect is about a."
    assert one(P.opinion("c", "t", "a", "chat")[0], c="c", t="t", a="a") == "c a"
    with pytest.raises(ValueError):
        P.label("c", "a", "other")


def test_split_and_truncate(one):
    assert one(R.split_terms("a"), a="a, b,c") == ["a", "b,c"]
    words = [f"w{i}" for i in range(300)]
    assert one(X.truncate_words("t"), t=" \n" + "  \n\t ".join(words)) == " ".join(words[:275])
    assert one(X.truncate_words("t"), t=" a b ") == "a b"
    assert one(X.truncate_words("t", 2), t=" a b c d") == "a b"
    assert one(X.truncate_words("t", 2), t="a") == "a"


def test_lines_and_ends(one):
    assert one(X.one_line("t"), t="　a\nb \n") == "a b"
    assert one(X.strip("t"), t=" " * 50_000 + "a" + " " * 50_000) == "a"


def test_time(one):
    assert one(S.stored_time(S.parse_comment_time("t")), t="31/03/2024, 21:28:15") == "2024-03-31 21:28:15"
    assert one(S.parse_comment_time("t"), t="2024-03-31 21:28") is None


def test_entropy_and_counts(one):
    assert one(X.entropy(X.words("t")), t="a a b b") == 1.0
    assert one(X.entropy(X.words("t")), t="...") is None
    got = one(X.word_counts(X.words("t")), t="b a b c b")
    assert [(r["word"], r["k"]) for r in got] == [("a", 1), ("b", 3), ("c", 1)]
    pairs = one(X.adjacent_pairs(X.words("t")), t="a b c")
    assert [(r["v"], r["w"]) for r in pairs] == [("a", "b"), ("b", "c")]
    assert one(X.adjacent_pairs(X.words("t")), t="a") == []
    assert one(X.adjacent_pairs(X.words("t")), t="") == []


def test_context_window(one):
    text = " ".join(f"w{i}" for i in "abcdefghijkl")
    got = one(X.context_window("t", F.lit("wc")), t=text)
    assert got == " ".join(f"w{i}" for i in "abcdefgh")
    assert one(X.context_window("t", F.lit("zz")), t=text) is None


def test_trace_record_round_trip(one):
    steps = [F.lit(None).cast("string") for _ in range(8)]
    record = R.trace_record("s", "t", F.lit("neutral"), F.lit(1), steps, F.lit("positive"))
    text = one(record, s="a\tb\n\n\nc", t="x")
    assert text.count("\n") == 9 and "\n\n\n" not in text
    f = one(R.trace_fields("r"), r=text)
    assert (f["sentence"], f["target"], f["gold"], f["implicit"], f["predicted"]) == ("a b   c", "x", "neutral", 1, "positive")
    assert one(R.trace_reject("r"), r=text) is None
    assert one(R.trace_reject("r"), r="a\nb") == "not ten lines"

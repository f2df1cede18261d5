import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textwarden.functions.dialect import JAVA, RE2, RegexError, literal, replacement, translate

# (pattern, flags, text, hit): what JavaScript answers.
CASES = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "", "é123-45-6789", True),
    (r"\b\d{3}-\d{2}-\d{4}\b", "", "x123-45-6789", False),
    (r"\b\d{3}-\d{2}-\d{4}\b", "", "123-45-6789é", True),
    (r"a\sb", "", "a\u00a0b", True),
    (r"a\sb", "", "a\ufeffb", True),
    (r"a\Sb", "", "a\u00a0b", False),
    (r"[\s]", "", "\u2003", True),
    (r"[^\s]", "", "\u2003", False),
    (r"[\S]", "", "\u2003", False),
    (r"a$", "", "a\n", False),
    (r"a$", "m", "a\nb", True),
    (r"^b", "", "a\nb", False),
    (r"^b", "m", "a\u2028b", True),
    (r"a.b", "", "a\u0085b", True),
    (r"a.b", "", "a\nb", False),
    (r"a.b", "s", "a\nb", True),
    (r"{{x}}", "", "{{x}}", True),
    (r"a{,2}", "", "a{,2}", True),
    (r"x{2", "", "x{2", True),
    (r"[a&&b]", "", "&", True),
    (r"[[a]", "", "[", True),
    (r"[A-Za-z0-9-_]+", "", "-", True),
    (r"[\w-.]", "", "-", True),
    (r"[^]", "", "\n", True),
    (r"[]", "", "a", False),
    (r"(a)\1", "", "aa", True),
    (r"(?<n>a)x\k<n>", "", "axa", True),
    (r"\x41\u0042\cJ", "", "AB\n", True),
    (r"\101", "", "A", True),
    (r"\1", "", "\x01", True),
    (r"é", "i", "É", True),
    (r"straße", "i", "STRAßE", True),
    (r"k", "i", "\u212a", False),
    (r"s", "i", "\u017f", False),
    (r"\u{1F600}", "u", "\U0001F600", True),
    (r"\p{Lu}", "u", "É", True),
    (r"\p{Script=Greek}", "u", "α", True),
    (r"(?=a)(?!ab)a", "", "ac", True),
    (r"(?<=\$)\d+", "", "$5", True),
    (r"(?<!\$)\b\d+", "", "$5", False),
    (r"\B-\B", "", " - ", True),
    (r"a\bb|c\b", "", "c.", True),
    (r"a*?b", "", "b", True),
    (r"a]b}", "", "a]b}", True),
    (r"\/\-\:", "", "/-:", True),
    (r"(?:x|\by)z", "", "ayz", False),
]


def test_patterns_mean_the_same_in_spark(spark):
    rows = [(i, text) for i, (_, _, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i INT, text STRING")
    tests = [
        F.when(F.col("i") == i, F.col("text").rlike(translate(p, f).pattern)).alias(f"c{i}")
        for i, (p, f, _, _) in enumerate(CASES)
    ]
    got = df.select("i", F.coalesce(*tests).alias("hit")).orderBy("i").collect()
    wrong = [CASES[r.i] for r in got if r.hit != CASES[r.i][3]]
    assert not wrong


@pytest.mark.parametrize(
    "pattern",
    ["[invalid((", "[[invalid", "(", ")", "a**", "+a", "a{1}{2}", "[b-a]", "a{3,1}", "(?<=a+)b",
     "\\", "(?a)", "(?<1>a)", "a++", "^*", "(?<n>a)(?<n>b)", "{1}", "(?<=a)*"],
)
def test_invalid_patterns_are_refused(pattern):
    with pytest.raises(RegexError):
        translate(pattern)


@pytest.mark.parametrize("flags", ["gg", "x", "y", "v", "uv"])
def test_bad_flags_are_refused(flags):
    with pytest.raises(RegexError):
        translate("a", flags)


REPLACEMENTS = [
    ("cost$", r"(a)(b)?", "cost$"),
    ("a$&b", r"x", "axb"),
    ("$$1", r"x", "$1"),
    ("$1$2", r"(x)", "x$2"),
    ("$10", r"(x)", "x0"),
    (r"back\slash", r"x", r"back\slash"),
    ("$<n>!", r"(?<n>x)", "x!"),
    ("$<n>", r"x", "$<n>"),
]


def test_replacement_strings(spark):
    df = spark.createDataFrame([("x",)], "t STRING")
    for text, pattern, wanted in REPLACEMENTS:
        regex = translate(pattern)
        source = "x" if "x" in pattern else "ab"
        out = df.select(
            F.regexp_replace(F.lit(source), F.lit(regex.pattern), F.lit(replacement(text, regex)))
        ).first()[0]
        assert out == wanted, (text, out)


def test_surroundings_cannot_be_inserted():
    with pytest.raises(RegexError):
        replacement("$`", translate("x"))


def test_re2_twin_folds_ascii_only():
    pattern = translate("ask", "i", RE2).pattern
    assert "(?i" not in pattern and "[aA]" in pattern


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=12))
def test_literal_matches_itself_only(text):
    import re

    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    import regex

    java_like = literal(text, JAVA)
    # The escapes used are shared by the regex module, but for \x{...}.
    portable = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", java_like)
    assert regex.fullmatch(portable, text)
    assert not regex.fullmatch(portable, text + "x")


NEEDLES = [
    (r"foo\bbar", "", "foobar"), (r"\bThat\s+and\b", "", "That"), (r"a|bcd", "", None), (r"x(abc)?", "", None),
    (r"x(?:abc)+y", "", "abc"), (r"(abc|d)ef", "", "ef"), (r"(?!secret)key", "", "key"), (r"ab*cd", "", "cd"),
    (r"FooBar", "i", "foobar"), (r"fé", "i", None), (r"fé", "", "fé"), (r"[ab]{3}", "", None), (r"(?:abc){0}de", "", "de"),
    (r"(?<=abc)de", "", "de"), (r"\u0041BC", "", "ABC"), (r"(a(bcd)e)\1", "", "bcd"), (r"ab{2}cde", "", "cde"),
]


def test_needles_are_what_every_match_holds():
    assert [translate(p, f).needle for p, f, _ in NEEDLES] == [n for _, _, n in NEEDLES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "(", ")", "|", "?", "*", "+", "{2}", "[ab]", "(?:", "."]), min_size=1, max_size=9),
       st.text("abc", min_size=0, max_size=10))
def test_no_match_lacks_its_needle(pieces, text):
    import regex

    try:
        done = translate("".join(pieces))
    except RegexError:
        return
    found = regex.search("".join(pieces), text)
    if found and done.needle:
        assert done.needle in found.group(0)

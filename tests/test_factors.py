import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.operators.factors import FOLDABLE, MOST, Literals, factors, folded
from evidara.operators.lexicon import Scanner
from evidara.plans.lexicons import WIDE


@pytest.mark.parametrize(
    "regex, wanted",
    [
        (r"\b(?:idiot|moron)\b", {"idiot", "moron"}), (r"(?:abc|de)x?fgh", {"abcfgh", "abcxfgh", "defgh", "dexfgh"}), (r"x[^.]{0,40}?Capture", {"capture"}), (r"a{2,3}bcd", {"bcd"}),
        (r"improced[êe]ncia", {"improcedencia", "improcedência"}), (r"foo(?=bar)baz", {"foobaz"}), (r"(?P<a>abc)(?P=a)", {"abc"}), (r"(?>abc)\d+", {"abc"}), (r"abc++\d", set()),
        (r"x[^.]*?capture|yy", set()), (r"\bab\b", set()), (r"\d+", set()), (r"", set()), (r"(?:abc)?", set()), (r"a[b-z]c", set()), (r"a[bc]d", {"abd", "acd"}), (r"straße", {"stra"}), (r"abc|", set()),
    ],
)
def test_factors_of_an_expression(regex, wanted):
    assert factors(regex) == wanted


def test_what_re_holds_for_equal_folds_alike():
    """Over all characters: a text's character that matches one of a literal without regard to case folds to the same."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    wrong = [(a, m) for a in sorted(FOLDABLE) for m in re.findall(re.escape(a), every, re.I) if folded(m) != folded(a)]
    assert not wrong


def test_factors_of_many_strings_are_few():
    assert len(factors("[ab]{1}[cd][ef][gh][ij][kl][mn][op]")) <= MOST


PIECES = st.recursive(
    st.sampled_from(["a", "k", "s", "i", "ab", "ß", "ã", "[ks]", "[^.]", r"\s", r"\b", ".", "(?=a)", "(?!k)", "K", "x"]),
    lambda r: st.one_of(
        st.lists(r, min_size=1, max_size=4).map("".join), st.lists(r, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"),
        st.tuples(r, st.sampled_from(["?", "*", "+", "{2}", "{0,3}?", "{1,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=12,
)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.text("akskibßãxKſıİK. ", max_size=24))
def test_no_match_without_a_factor(regex, text):
    """Any match found in a random text holds a factor of its expression, and the automaton says that it may match."""
    found = re.search(regex, text, re.I | re.S)
    held = factors(regex)
    if found and held:
        assert any(f in folded(found[0]) or f in folded(text) for f in held)
    if found:
        assert Literals([regex, "qqqq"]).possible(text) & 1


def test_hits_are_those_of_every_pattern_tried():
    words = [f"the of and {a}{b} {a} {b}tion, {a.upper()} {b}TION." for a in ("the", "in", "is", "as") for b in ("of", "it", "by", "from", "the")]
    text = " ".join(words * 2)
    some, plain = Scanner(WIDE, WIDE.patterns), Scanner(WIDE, WIDE.patterns)
    plain.literals.possible = lambda text: (1 << len(WIDE.patterns)) - 1
    assert some.hits(text) == plain.hits(text) != []
    assert bin(some.literals.possible(text)).count("1") < len(WIDE.patterns)

"""Properties of pure helpers under generated input."""

import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from evidara.functions import parsing  # noqa: E402
from evidara.operators import lexicon as L  # noqa: E402
from evidara.plans.tables import LEXICON  # noqa: E402
from evidara.sources import records, sinks  # noqa: E402

values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), values, max_size=4), max_size=6), st.integers(1, 40))
def test_objects_of_any_layout(rows, chunk):
    import io

    for text in (json.dumps(rows), json.dumps(rows, indent=1), "\n".join(map(json.dumps, rows))):
        assert list(records.objects(io.StringIO(text), chunk)) == rows


pieces = st.lists(st.sampled_from(["idiot", "MORON", "licensed under the ", "License", ".", " ", "nicht", "stupid", "é", "\n", "version 3", "x"]), max_size=25)


@settings(max_examples=150, deadline=None)
@given(pieces)
def test_prefilter_never_loses_a_candidate(parts):
    text = "".join(parts)
    found = L.Scanner(LEXICON, LEXICON.of_tiers(LEXICON.candidate_tiers)).hits(text)
    kept = pc.match_substring_regex(pa.array([text]), "(?s)" + L.prefilter_source(LEXICON), ignore_case=True)[0].as_py()
    assert kept or not found
    assert all(text[h["start"] :][:1] for h in found) and found == sorted(found, key=lambda h: (h["start"], h["pattern_id"]))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_parsers_take_any_text(text):
    parsing.items_of(text)
    assert len(parsing.citations_of(text)) == len(parsing.CITATION.findall(text.strip())) or not text.strip()
    parsing.laws_of(text)


@given(st.lists(st.text(alphabet="ab1_ &", max_size=6), min_size=1, max_size=3))
def test_macro_names_have_letters_only(parts):
    assert all(c.isalpha() for c in sinks.macro(*parts))

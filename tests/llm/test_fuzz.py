from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.leaks import ItemIndex, _search
from graphloom.llm.packing import count_tokens, encoder, token_ids
from graphloom.llm.spam import spam_share
from graphloom.llm.words import plain, words
from tests.llm.test_leaks import covered_in_order

TEXT = st.text(max_size=300) | st.text(alphabet="ab .<>/&#;\n|-=()[]:", max_size=300)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert 0 <= spam_share(text) <= 1
    assert all(w and w == w.lower() for w in words(text)) or plain(text)
    assert count_tokens(text) >= 0


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
@settings(max_examples=200, deadline=None)
def test_tokens_round_trip(text):
    assert encoder().decode(token_ids(text).tolist()) == text


@given(st.lists(st.text(alphabet="abc ", max_size=60), max_size=5), st.lists(st.text(alphabet="abc ", max_size=120), max_size=4))
@settings(max_examples=100, deadline=None)
def test_search_equals_brute_force(passages, texts):
    import pandas as pd

    items = [(i, p, "", "") for i, p in enumerate(passages)]
    out = pd.concat(list(_search([ItemIndex(items)], 0.25)(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]))))
    expected = set()
    for d, t in enumerate(texts):
        w = words(t)
        for i, p, _, _ in items:
            q = words(p)
            n = covered_in_order(w, q)
            if n and n >= 0.25 * len(q):
                expected.add((d, i))
    assert set(zip(out["doc_id"], out["item_id"], strict=True)) == expected

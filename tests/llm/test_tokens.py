import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.tokens import encoder, encoding

PIECES = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "'s", "'", "word", "Wörter", "42", "²", "!?", "日本", "👍🏽", "_", "\x00"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@settings(max_examples=1500, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_those_of_the_pattern_that_looks_ahead(name, parts):
    text, path = "".join(parts), public_tokenizers.path(name)
    want = encoding(path, public_tokenizers.PATTERN).encode_ordinary(text)
    assert encoder(path, public_tokenizers.PATTERN).cut
    assert encoder(path, public_tokenizers.PATTERN).ids(text).tolist() == want


def test_other_patterns_are_matched_as_they_are():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for pattern in (r"\s+|\S+", r"[\s\S]"):
        text = "some  words \n\n and more   "
        assert encoder(path, pattern).ids(text).tolist() == encoding(path, pattern).encode_ordinary(text)


def test_every_code_point_between_blanks():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = "".join(f"  {chr(i)} a" for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    assert encoder(path, public_tokenizers.PATTERN).ids(text).tolist() == encoding(path, public_tokenizers.PATTERN).encode_ordinary(text)

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import brute, docs, edge_docs
from tokenizers import Tokenizer

from docengine.llm import bpe
from docengine.llm.queries import op1_bpe, tokenizer_path

PATH = tokenizer_path()
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Codec(open(PATH, "rb").read())


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = OURS.encode(text)
    assert ids == theirs(text)
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "a", "don't  stop\n\n now", "<|endoftext|>a <|endoftext|>", "<|endoftext", "é" * 500, "abc" * 3000, "x" * 5000, " " * 400, "\u0085  x", "日本語テキスト", "՘֋", "👩‍👩‍👧"])
def test_given_texts(text):
    ids = OURS.encode(text)
    assert ids == theirs(text)
    assert OURS.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abehilnorst é"), min_size=2, max_size=300))
def test_heap_and_array_agree(letters):
    parts = [OURS.byte_ids[b] for b in "".join(letters).encode()]
    assert OURS.merged(list(parts)) == OURS.merged_long(list(parts))


def test_decode_of_partial_characters():
    ids = theirs("日本")[:1]
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in op1_bpe(spark, sf_dir).collect()}
    for key, text in brute(spark, sf_dir):
        ids = theirs(text or "")
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_operators_and_edges(spark):
    df = edge_docs(spark)
    coded = bpe.encode(df, PATH)
    assert coded.columns == [*df.columns, "token_ids"]
    back = bpe.decode(coded, PATH).collect()
    assert len(back) == df.count() and all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(docs(spark, []), PATH).count() == 0
    clash = df.withColumnRenamed("size", "token_ids")
    assert all(r.token_ids == theirs(r.text or "") for r in bpe.encode(clash, PATH).collect())
    assert bpe.round_trip(df, PATH).where("doc_id is null").first().n_tokens == len(theirs("a row without an id"))


def test_other_tokenizers_are_refused():
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"type": "WordPiece"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_supported(spec | change)

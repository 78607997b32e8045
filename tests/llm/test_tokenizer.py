from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm.tokenizer import TOKENIZER, PrefixBPE, PrefixTable, encode_documents

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="needs the vocabulary file")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return PrefixBPE(Path(TOKENIZER).read_text(encoding="utf-8"))


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "\n\n \t x", "Hello world's  tests", "don't  re've x", "<|endoftext|>", "😀👩‍🔬🇩🇪", "hélló İone", "한국어 中文。日本", "a" * 3000, "  　 ", "1234567890" * 20, "x\0y", "ﬁ½10⁻³"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(bpe, other, text):
    assert bpe.encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(bpe, other, text):
    assert bpe.encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="aehinorst ", max_size=80))
def test_frequent_letters(bpe, other, text):
    assert bpe.encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(data=st.binary(max_size=40), more=st.binary(max_size=20), start=st.integers(0, 40), end=st.integers(0, 40), new=st.binary(max_size=10))
def test_appends_and_edits_equal_a_new_encoding(bpe, data, more, start, end, new):
    table = PrefixTable(bpe, data).append(more)
    assert table.ids() == PrefixTable(bpe, data + more).ids()
    whole = data + more
    start, end = sorted((min(start, len(whole)), min(end, len(whole))))
    table.replace(start, end, new)
    assert table.data == whole[:start] + new + whole[end:]
    assert table.ids() == PrefixTable(bpe, table.data).ids()
    # Every prefix's encoding is in the table.
    for n in range(len(table.data) + 1):
        at, ids = n, []
        while at:
            ids.append(table.last[at - 1])
            at -= bpe.lengths[ids[-1]]
        assert ids[::-1] == PrefixTable(bpe, table.data[:n]).ids()


def test_documents(spark, other):
    data = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(100, None, "x", "y"), (101, "again", "", ""), (101, "again", "", ""), (None, "no key", "", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string, __text string")
    out = encode_documents(df, "doc_id", "text")
    assert out.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    got = out.collect()
    assert len(got) == len(data)
    for key, text, *_ in data:
        want = other.encode(text, add_special_tokens=False).ids if text else []
        assert [r["ids"] for r in got if r["doc_id"] == key][0] == want
    assert encode_documents(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab the\n1é", max_size=120), new=st.text(alphabet="ab the\n1é", max_size=6), a=st.integers(0, 200), b=st.integers(0, 200))
def test_edits_equal_encoding_anew(bpe, text, new, a, b):
    data, more = text.encode(), new.encode()
    start, end = sorted((min(a, len(data)), min(b, len(data))))
    table = PrefixTable(bpe, data).replace(start, end, more)
    assert table.data == data[:start] + more + data[end:] and table.last == PrefixTable(bpe, table.data).last


def test_an_edit_finds_few_entries_again(bpe):
    table = PrefixTable(bpe, b"the patients of the trial were seen again after a year " * 400)
    before = table.computed
    table.replace(5000, 5003, b"never")
    assert table.computed - before < 4 * bpe.longest < len(table.data) - 5000
    assert table.last == PrefixTable(bpe, table.data).last

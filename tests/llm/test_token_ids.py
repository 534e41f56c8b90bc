import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hybrispark.llm import lexicon
from hybrispark.llm import token_ids as ti

pytestmark = pytest.mark.skipif(not os.path.exists(ti.VOCABULARY), reason="no vocabulary")
TEXTS = ["", "Hello  world\n\n x", "I'd've 's 'll don't  x\t", "'", " '", "\n'll x'LL it's'l", "日本語 テスト１２ ½", "a b 　c", "x" * 5000, "  ", "é\r\n\r\n 9"]


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "a.bin"
    tokenizer, ranks = ti._tokenizer(ti.VOCABULARY)
    lexicon.save(lexicon.build({p: tokenizer._encode_single_piece(p) for p in list(ranks)[:5000]}), path)
    return ti.Encoder(ti.VOCABULARY, str(path))


def split(encoder, texts):
    ids, sizes = encoder.encode(texts)
    out, at = [], 0
    for n in sizes.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_known_texts(encoder):
    assert split(encoder, TEXTS) == [encoder.tokenizer.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sdtlrve \n\t.,9é日 　😀"), max_size=30), min_size=1, max_size=4))
def test_any_text(encoder, texts):
    assert split(encoder, texts) == [encoder.tokenizer.encode_ordinary(t) for t in texts]


def test_automaton_round_trip(tmp_path):
    import numpy as np

    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "a", "é"])}
    lexicon.save(lexicon.build(words), tmp_path / "x")
    lex = lexicon.load(tmp_path / "x")
    asked = [*words, b"to", b"tapsx", b"z"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    rank = lexicon.find(lex, data, ends - [len(w) for w in asked], ends)
    for w, r in zip(asked, rank.tolist()):
        assert (r < 0) == (w not in words)
        if r >= 0:
            assert lex["ids"][lex["offset"][r] : lex["offset"][r + 1]].tolist() == words[w]
    assert len(lex["base"]) < sum(len(w) for w in words)


def test_operator(spark):
    data = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 2), (50, None, 3), (51, "long text of words " * 3000, 4), (0, "", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int").repartition(3)
    tokenizer, _ = ti._tokenizer(ti.VOCABULARY)
    got = sorted(((r.doc_id is None, r.doc_id, r.ids) for r in ti.token_ids(df, slice_chars=2000).collect()), key=str)
    assert got == sorted(((i is None, i, tokenizer.encode_ordinary(t) if t else []) for i, t, _ in data), key=str)
    assert ti.token_ids(df.limit(0)).collect() == []

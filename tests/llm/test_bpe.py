from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrutari.llm import bpe

from awkward_rows import TEXTS, table


def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def same(texts):
    v, t = bpe.load(), library()
    tokens, at = v.encode(texts)
    for s, i, j in zip(texts, at, at[1:]):
        own = tokens[i:j].tolist()
        assert own == (t.encode(s, add_special_tokens=False).ids if s else [])
        assert v.decode(own) == (s or "")


def test_like_the_library():
    same([t for _, t in TEXTS] + ["aaaaaaaaaaaaa aaaa", "<|endoftext|>", "don't they'll", "abababab" * 300, "  \n\n  x  ", " 　z", "123456 7", "ﬁ ①"])


@given(st.lists(st.text(max_size=60).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text(texts):
    same(texts)


def test_batches_do_not_matter():
    v = bpe.load()
    texts = [t for _, t in TEXTS if t] * 2
    all_, at = v.encode(texts)
    for s, i, j in zip(texts, at, at[1:]):
        assert v.encode([s])[0].tolist() == all_[i:j].tolist()


def test_ids_that_are_not_in_the_vocabulary():
    v = bpe.load()
    assert v.decode([10**6, None, 50256]) == "��<|endoftext|>"
    assert v.decode([v.byte_id[0xC3]]) == "�"


def test_frames(spark, awkward, nothing):
    for out in ("tokens", "TOKENS", "ids"):
        there = bpe.encode(awkward, out_col=out)
        assert there.columns[-1] == out and there.count() == awkward.count()
    rows = bpe.encode(awkward).collect()
    t = library()
    for r in rows:
        assert r["tokens"] == (None if r["text"] is None else t.encode(r["text"], add_special_tokens=False).ids)
    back = bpe.decode(bpe.encode(awkward, out_col="ids"), "ids", "again").collect()
    assert all(r["again"] == r["text"] for r in back) and len(back) == len(TEXTS)
    assert bpe.encode(nothing).count() == 0 and bpe.coded(nothing).count() == 0


def test_query(spark, folder):
    t = library()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = bpe.query(spark, folder).collect()
    assert len(rows) == len(texts) + 20
    for r in rows:
        s = texts[r["doc_id"]]
        want = None if s is None else t.encode(s, add_special_tokens=False).ids
        assert r["tokens"] == want and r["n_tokens"] == (None if s is None else len(want)) and r["exact"] == (None if s is None else True)

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatim.llm import bpe
from verbatim.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary_path()
THEIRS = tokenizers.Tokenizer.from_file(PATH)
OURS = bpe.vocabulary(PATH)
PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "\x1c", "\x85", " ", "᠎", "　", "'s", "'t", "1", "²", "中", "😀", "<|endoftext|>", "<|endof", "the", " of", "\t", "\0", "́", "%", "!!", "\r"]


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert list(OURS.ids_of(text)) == want
    assert OURS.text_of(want) == THEIRS.decode(want, skip_special_tokens=False) == text


def test_made_texts():
    rng = random.Random(8)
    for _ in range(4000):
        same("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))))
    same("x" * 30_000)
    same(" " * 5000 + "word " * 5000)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


def test_any_ids():
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 9))]
        assert OURS.text_of(ids) == THEIRS.decode(ids, skip_special_tokens=False)
    assert OURS.text_of([-1, 99_999]) == ""


def test_columns(docs):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "<|endoftext|> é\n"), (None, "x " * 40_000)]
    out = docs(rows).select("doc_id", "text", "score", bpe.encode(F.col("text"), PATH).alias("ids"))
    out = out.withColumn("back", bpe.decode(F.col("ids"), PATH)).collect()
    for r in out:
        assert r.ids == THEIRS.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    assert docs([]).select(bpe.encode(F.col("text"), PATH)).count() == 0
    null = docs([(1, "x")]).select(bpe.decode(F.lit(None).cast("array<int>"), PATH).alias("t")).first()
    assert null.t == ""

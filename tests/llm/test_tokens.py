import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import tokens as K

if not Path(K.VOCABULARY).exists():
    pytest.skip("no vocabulary", allow_module_level=True)


@pytest.fixture(scope="module")
def both():
    import tiktoken

    raw = Path(K.VOCABULARY).read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return K.Encoder(raw), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    if text.isprintable() or text.encode("utf-8", "ignore").decode() == text:
        assert both[0].encode(text) == both[1].encode_ordinary(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", " " * 3000, "a" * 20000, "日本語テキスト" * 300, "🚀👩‍💻é́", "=" * 999, "it's  they'LL\r\n\r\n\t x", "​﻿"])
def test_hard_texts(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)
    assert b"".join(both[0].tokens[i] for i in both[0].encode(text)) == text.encode()


def test_table(spark, both):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (4, "   ", "x"), (5, "word " * 50_000, None), (1, "some text", "x"), (None, "null key", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in K.token_ids(df).collect())
    assert got == sorted((i or 0, both[1].encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert K.token_ids(df.limit(0)).count() == 0

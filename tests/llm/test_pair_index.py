"""Own pair merging against the library: ids, decoded texts and digests."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketry.llm import pair_index

NAME = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
PARTS = ["a", "B", "aaa", "ß", "é", "é", "́", " ", "  ", "\n", "\n\n", "\t", "\xa0", "'s", "'ll", "'", "1", "23", ".", "!!", "<|endoftext|>", "<|startoftext|>",
         "<|", "中", "İ", "Σ", "ΑΣ", "\u2003", "\x1c", "\0", "\r", "😀", "word", " the", "ÿ", "Ω", "\U0001d400", "banana", "mississippi"]


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(codec, texts):
    ids, lengths = codec.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    got = [ids[end - n:end].tolist() for end, n in zip(ends, lengths, strict=True)]
    assert got == [plain(text) for text in texts]
    assert codec.decode(ids, lengths).to_pylist() == [LIBRARY.decode(x, skip_special_tokens=False) for x in got]


@given(texts=st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_and_texts_are_the_library_s(texts):
    check(pair_index.codec(NAME), [x.encode("utf-8", "ignore").decode() for x in texts])


def test_long_words_and_overlapping_pairs():
    rng = random.Random(2)
    words = ["a" * n for n in range(1, 70)] + ["x" * 30_000, "ab" * 5000, "".join(rng.choice("lo") for _ in range(4000))]
    check(pair_index.Codec(NAME), [" ".join(words), *words, ""])


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(pair_index, "MAX_PIECES", 40)
    codec, rng = pair_index.Codec(NAME), random.Random(1)
    for _ in range(30):
        check(codec, [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30)) for _ in range(3)])
        assert len(codec.table) <= 120


def test_merges_that_make_earlier_ranks_are_refused():
    model = {"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "end_of_word_suffix": "</w>", "merges": [["ab", "a"], ["a", "b"]]}
    with pytest.raises(ValueError, match="earlier ranks"):
        pair_index.Merges(model)


def test_documents(spark, docs, rows):
    want = sorted((str(key), plain(text)) for key, text, _ in rows)
    encoded = pair_index.encode(docs)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"]) for r in pair_index.decode(encoded).collect()) == [(key, LIBRARY.decode(ids, skip_special_tokens=False)) for key, ids in want]


def test_digests(spark, docs, rows, no_docs):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = sorted((str(key), len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))
                  for key, text, _ in [*rows, *rows] for ids in [plain(text)])
    got = pair_index.round_trip_digests(docs.union(docs))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert pair_index.round_trip_digests(no_docs).count() == 0
    assert pair_index.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, ""), (2, "")]

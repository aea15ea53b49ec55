import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import encode, ngram_model, packing, token_cache, token_files
from docketry.session import work_dir

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LIBRARY = {name: Tokenizer.from_file(encode.vocabulary_path(name)) for name in NAMES}


def plain(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = ["a", "B", "ß", "é", "e\u0301", "\u0301", " ", "  ", "\n", "\n\n", "\t", "\xa0", "'s", "'", "1", "23", ".", "!!", "<|endoftext|>", "<|", "中", "İ", "Σ",
         "\u2003", "\x1c", "\0", "\r", "😀", "word", " the"]


@pytest.mark.parametrize("name", NAMES)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_as_whole_texts(name, texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    ids, lengths = encode.encoder(name).encode(texts)
    ends = np.cumsum(lengths)
    assert [ids[end - n:end].tolist() for end, n in zip(ends, lengths, strict=True)] == [plain(name, x) for x in texts]


def test_a_full_table_of_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(encode, "MAX_PIECES", 40)
    coder = encode.Encoder(NAMES[0])
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30)) for _ in range(3)]
        assert coder.encode(texts)[0].tolist() == sum((plain(NAMES[0], x) for x in texts), [])


@given(st.lists(st.integers(0, 300), min_size=1, max_size=4000), st.integers(1, 64))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(values, lanes):
    ids = np.array(values, np.uint32)
    coder = token_files.Coder(token_files.normalised(np.bincount(ids)))
    data = coder.encode(ids, lanes)
    assert (coder.decode(data) == ids).all()
    middle = len(ids) // 2
    assert (coder.decode(data, middle, middle + 9) == ids[middle:middle + 9]).all()
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(data[:30] + bytes([data[30] ^ 1]) + data[31:])


def test_frequencies_fill_the_scale_and_keep_rare_symbols():
    counts = np.array([10 ** 12, 1, 0, 1, 5])
    table = token_files.normalised(counts)
    assert table.sum() == 1 << token_files.SCALE_BITS and ((table > 0) == (counts > 0)).all()


def test_token_files_round_trip(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    path = work_dir(spark, "token-files")
    token_files.write_token_files(docs, path)
    assert spark.read.parquet(f"{path}/blocks").count() > 2
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    at, texts = 0, {i: t for i, t, _ in rows if i is not None}
    for row in got:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["start"] == at and row["n_tokens"] == len(ids) and ids[-1] == 0
        at += len(ids)
        if row["doc_id"] is not None:
            assert ids[:-1] == plain(NAMES[0], texts[row["doc_id"]])


def test_token_files_of_nothing(spark, no_docs):
    path = work_dir(spark, "token-files")
    token_files.write_token_files(no_docs, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_cache_encodes_each_content_once(spark, docs, no_docs, rows):
    cache = work_dir(spark, "token-counts")
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(plain(NAMES[1], t))) for i, t, _ in rows)
    for _ in range(2):  # the second time everything comes from the cache
        got = token_cache.count_tokens(docs, NAMES[1], cache).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("digest").distinct().count()
    assert token_cache.count_tokens(no_docs, NAMES[1], cache).count() == 0
    # a stored count is read, not made again, and counts of another version are not
    cache, digest = work_dir(spark, "token-counts"), spark.range(1).select(token_cache.content_digest(F.lit(" a\n"), NAMES[1])).first()[0]
    stored = [(token_cache.version_of(NAMES[1]), digest, 99), ("other", digest, 98)]
    spark.createDataFrame(stored, token_cache.CACHE).write.parquet(cache)
    assert [r["n_tokens"] for r in token_cache.count_tokens(docs.filter("text = 'a'"), NAMES[1], cache).collect()] == [99]


def check_packing(got, rows, end_id, capacity):
    by_key, sequences = {}, {}
    for row in got:
        by_key.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for key, text, _ in rows:
        if key is None:
            continue
        ids, at = [*plain(NAMES[0], text), end_id], 0
        for n, row in enumerate(sorted(by_key[key], key=lambda r: r["piece"])):
            assert (row["piece"], row["start"], row["ids_crc32"]) == (n, at, crc(ids[at:at + row["length"]]))
            assert row["length"] == capacity or n == 0
            at += row["length"]
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, no_docs, rows):
    check_packing(packing.pack(docs).collect(), rows, 2, 1024)
    check_packing(packing.pack(docs, capacity=100, with_ids=False).collect(), rows, 2, 100)
    assert packing.pack(no_docs).count() == 0


def test_two_pieces_replace_the_smallest():
    # greedy alone fills 6 + 3 and leaves a gap of 1; the 3 makes room for two of 2
    steps = packing.plan_packing({6: 1, 3: 1, 2: 2}, 10)
    assert steps[0] == ([(6, 1), (2, 2)], 1)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1), st.integers(64, 80))
@settings(max_examples=80, deadline=None)
def test_plan_places_every_piece_once(histogram, capacity):
    steps = packing.plan_packing(histogram, capacity)
    placed = {}
    for pattern, times in steps:
        assert sum(length * n for length, n in pattern) <= capacity and times > 0
        for length, n in pattern:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    assert sum(times for _, times in steps) <= 1 + 1.5 * sum(k * v for k, v in histogram.items()) / capacity + sum(histogram.values()) * (max(histogram) > capacity / 2)


def brute_scores(background, target, size=50_257):
    from collections import Counter
    from math import log

    def model(texts):
        pairs = Counter(p for ids in texts for p in zip([size, *ids], ids, strict=False))
        word, context, kinds = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            word[b] += n
            context[a] += n
            kinds[a] += 1
        total = sum(word.values())

        def loss(a, b):
            lower = (word[b] + 1) / (total + size + 1)
            return -log((pairs[a, b] + kinds[a] * lower) / (context[a] + kinds[a]) if context[a] else lower)
        return loss
    near, far = model(target), model(background)
    return [sum(near(a, b) - far(a, b) for a, b in zip([size, *ids], ids, strict=False)) / len(ids) if ids else 0.0 for ids in background]


def test_cross_entropy_difference(spark, docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_model, "SHARD_TOKENS", 3000)
    target = [(None, "the river sings of the night"), (None, None), (None, "stone and rain")]
    items = spark.createDataFrame(target, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_model.score(docs, items).collect() if r["doc_id"] is not None}
    keyed = [row for row in rows if row[0] is not None]
    want = brute_scores([plain(NAMES[0], t) for _, t, _ in [*keyed, *[r for r in rows if r[0] is None]]], [plain(NAMES[0], t) for _, t in target])
    for (key, text, _), score in zip(keyed, want, strict=False):
        assert got[key]["n_tokens"] == len(plain(NAMES[0], text)) and got[key]["score"] == pytest.approx(score, abs=1e-9)
    assert ngram_model.score(no_docs, items).count() == 0
    assert ngram_model.score(docs, items.limit(0)).count() == len(rows)


@given(st.lists(st.integers(0, 1 << 40), max_size=9))
def test_counts_beyond_32_bits(values):
    counts = np.array(values, np.int64)
    data = ngram_model.packed(counts)
    assert ngram_model.unpacked(data, len(values)).tolist() == values
    assert len(data) == len(values) * (8 if max(values, default=0) >= 1 << 32 else 4)


def test_large_counts_reach_the_scores(monkeypatch, spark, docs):
    """Counts as of a corpus of many billions of words, some above and some below 32 bits, as a range answers them."""
    monkeypatch.setattr(ngram_model, "RANGE_BIGRAMS", 50)
    keys, counts = np.arange(40, dtype=np.uint32), np.arange(40, dtype=np.int64) << 28
    place = ngram_model._ranges_of(keys, 3)
    sizes = np.bincount(place, minlength=3)
    sent = [ngram_model.packed(counts[place == i]) for i in range(3)]
    got = np.concatenate([ngram_model.unpacked(data, n) for data, n in zip(sent, sizes, strict=True)])
    assert got.tolist() == np.concatenate([counts[place == i] for i in range(3)]).tolist() and got.max() > 1 << 32
    items = docs.limit(9)
    one, two = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in ngram_model.score(docs.repartition(n), items).collect()} for n in (1, 5))
    assert one == two

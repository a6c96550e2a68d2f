"""What the text operators cost: CPU, memory and disk that once grew beyond their limits."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe, common, decontaminate, minhash, phrases
from tidemark.llm.common import batch, lean, worker_store


def test_sums_by_feature_are_right_and_several_times_faster_than_reduceat():
    rng = np.random.default_rng(3)
    group = np.sort(rng.zipf(1.3, 100_000) % 5000).astype(np.int32)
    rows = rng.integers(0, 4096, len(group))
    vectors = rng.standard_normal((4096, decontaminate.RANK)).astype(np.float32)
    borders = np.flatnonzero(np.diff(group, prepend=-1))

    def seconds(work):
        began = time.process_time()
        return work(), time.process_time() - began

    expected, before = seconds(lambda: np.add.reduceat(vectors[rows], borders, axis=0))
    (feature, sums), after = seconds(lambda: decontaminate._summed_by(group, vectors, rows))
    assert (feature == group[borders]).all()
    assert np.allclose(sums, expected, atol=1e-2)
    assert 2 * after < before


@pytest.mark.parametrize("most, width", [(1 << 20, 4), (1 << 40, 8)])
def test_counted_pairs_are_dealt_in_few_bytes(most, width):
    rng = np.random.default_rng(4)
    code = np.unique(rng.integers(0, 50_000, 20_000) << 32 | rng.zipf(1.2, 20_000) % 50_000)
    prefix, suffix, n = code >> 32, code & 0xFFFFFFFF, np.minimum(rng.zipf(2.5, len(code)), 1000)
    prefix[-1] = most
    packed, got = phrases._packed(prefix, suffix, n)
    assert got == width and len(packed) < 5 * len(n)  # 12 bytes, 24 where a number is wide, before compression
    assert (phrases._unpacked(packed, len(n), width) == [prefix, suffix, n]).all()


def test_places_of_the_last_length_are_not_stored(spark):
    docs = spark.createDataFrame([("en", "to be or not to be")] * 40, "lang string, text string")
    relation = phrases.occurrences(docs)
    words = phrases.frequent_words(relation, 30)
    assert "places" in phrases.extend(relation, ["lang", "word"], words).columns
    assert phrases.extend(relation, ["lang", "word"], words, True).columns == ["block", "prefix", "suffix", "n"]


def test_shingles_of_a_large_batch_hold_bounded_memory():
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 700))) for _ in range(12_000)]  # 80 MB
    whole = batch(doc_id=pa.array(range(len(texts)), pa.int64()), text=pa.array(texts))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in minhash._sets_of(5)(iter([whole])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 80 << 20, peak


def test_a_worker_frees_what_other_operators_remembered():
    worker_store("bpe")["words"] = {"a": b"1"}
    list(lean(iter, "bpe")([1]))
    assert worker_store("bpe")["words"] == {"a": b"1"}
    list(minhash._describe(5)(iter([])))
    assert worker_store("bpe") == {}


def test_matches_remembered_beside_words_are_few():
    model, encoder = bpe._encoder({bytes([i]): i for i in range(256)}, r"\S+|\s+")
    for i in range(4):
        bpe.packed_ids(encoder, pa.array([" ".join(f"w{i}x{k}" for k in range(60_000))]))
    assert len(worker_store("bpe")["words"]) > 230_000 and len(worker_store("bpe")["matches"]) <= bpe.MATCH_ENTRIES + 60_001


def test_frequent_words_outlive_a_full_memo(monkeypatch):
    monkeypatch.setattr(common, "MEMO_ENTRIES", 100)
    asked: list[str] = []

    def encode_all(parts):
        asked.extend(parts)
        return [np.array([len(p), sum(map(ord, p))], "<u4").tobytes() for p in parts]

    store: dict = {}
    encoder = common.PartEncoder(store, encode_all)
    for i in range(40):
        words = ["often", *(f"w{i}x{k}" for k in range(20)), "x" * 200]
        ids, first = encoder.encode(pa.array(["head " + " ".join(words)]))
        assert ids.tobytes() == b"".join(encode_all(["head", *(f" {w}" for w in words)])) and first.tolist() == [0, len(ids)]
        del asked[-len(words) - 1 :]
        assert len(store["words"]) + len(store["old words"]) <= 2 * (100 + len(words))
    assert asked.count(" often") == 1 and asked.count(" " + "x" * 200) == 40

"""Periodic runs against plain searches, the planted documents of the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, repeats=4, least=6):
    """All runs, by looking at every period and every word."""
    found = {}
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, repeats * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sample_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(1, 8)):
            letters = "ab" if rng.random() < 0.4 else "abcdefgh"
            part = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
            words += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randrange(0, len(part))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("repeats", "least"), [(4, 6), (2, 2), (3, 10)])
def test_kernel_finds_all_runs(seed, repeats, least):
    texts = [t.encode().split() for t in sample_texts(seed)]
    runs, left = periodic_runs._search([*texts, []], repeats, least)
    for words, got, rest in zip(texts, runs, left):
        want = plain_runs(words, repeats, least)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
        assert rest == plain_collapsed([w.decode() for w in words], want)
    assert runs[-1] == [] and left[-1] == ""


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(3)
    words = np.r_[rng.integers(1, 3, 400), np.tile([1, 2, 2], 90), 9]
    ext = periodic_runs.Extensions(words)
    i, j = rng.integers(0, len(words), (2, 3000))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i, j, ext.common(i, j)):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        assert got == n


def test_grid_in_small_parts(monkeypatch):
    texts = [t.encode().split() for t in sample_texts(11)]
    whole = periodic_runs._search(texts, 4, 6)
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    assert periodic_runs._search(texts, 4, 6) == whole


def test_rows_that_lack_repeat_or_clash(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS", 40)
    long = " ".join(f"w{i % 7000}" for i in range(40_000))
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "x　y\x1cz " * 4, long, "é b\tc\x0bé b c é b c é b c"]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "a " * 9, None, None), (3, "a", "n", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    out = periodic_runs.find_runs(df).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in out}
    assert got[(0, "")] == got[(1, "")] == got[(2, "")] == [] and got[(4, "a a a a a")] == []
    assert got[(5, "a")] == [(0, 6, 1)] and got[(None, "a")] == [(0, 9, 1)]
    assert got[(6, "x　y\x1cz x　y\x1cz x　y\x1cz x　y\x1cz")] == []
    assert got[(7, " ".join(f"w{i}" for i in range(7000)))] == [(0, 40_000, 7000)]
    assert got[(8, "é b c")] == [(0, 12, 3)]
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, repeats=1)


def test_query_over_all_documents(spark):
    out = {r.doc_id: r for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(out) == len(docs)
    some = 0
    for d in docs:
        words = planted(d.doc_id, [w.decode() for w in (d.text or "").encode().split()])
        runs = plain_runs(words)
        r = out[d.doc_id]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = best[1] and 1000 * best[1] // best[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        some += len(runs)
    assert some > 5

"""Phrases against plain counting, with many small blocks, and rows that lack, repeat or clash."""

import collections
import random
import re

import pytest

from tidemark.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(docs, longest, least, percent):
    """``lang, phrase, a, l, r, n, score`` from counts of all phrases."""
    counts, words = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                part = (lang, ws[i : i + k])
                if 100 * a >= percent * counts[part]:
                    covered.add(part)
    out = set()
    for (lang, ws), a in candidates.items():
        cuts = [(counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws))]
        l, r = min(cuts, key=lambda c: 2_000_000 * a // (c[0] + c[1]))
        if (lang, ws) not in covered:
            out.add((lang, " ".join(ws), a, l, r, words[lang], 2_000_000 * a // (l + r)))
    return out


def sample_docs(seed, n=60):
    rng = random.Random(seed)
    fixed = ["New York City hall", "the end of", "Ümlaut  straße", "a a a a", "x y 日本 語", "b\tc"]
    docs = [(None, None), ("en", ""), ("en", " .,\n"), ("de", "one"), (None, "a a a a a a a")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice("abcdefg") for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " "]) for p in parts)
        docs.append((rng.choice(["en", "de", None]), text))
    return docs


@pytest.mark.parametrize(("block", "longest", "least", "percent", "lookup"), [
    (1_000_000, 4, 5, 80, 10**6), (25, 4, 3, 50, 10**6), (1, 3, 2, 80, 0), (40, 6, 4, 100, 12),  # looked up, joined, both
])
def test_phrases_equal_plain_counts(spark, monkeypatch, block, longest, least, percent, lookup):
    for name, value in (("BLOCK_WORDS", block), ("PART_PHRASES", 50), ("PART_ROWS", 7), ("LOOKUP_WORDS", lookup), ("LOOKUP_PHRASES", lookup)):
        monkeypatch.setattr(phrases, name, value)
    docs = sample_docs(block)
    df = spark.createDataFrame([(lang, text, "x", 1, 2) for lang, text in docs], "lang string, text string, phrase string, n int, a int")
    out = phrases.mine_phrases(df.repartition(5), longest=longest, least=least, covered_percent=percent).collect()
    got = {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out}
    assert len(got) == len(out) and got == plain_phrases(docs, longest, least, percent)
    assert any(r.words == longest for r in out) and all(r.words == r.phrase.count(" ") + 1 for r in out)


def test_one_text_repeated_and_one_very_long(spark):
    docs = [("en", "to be or not to be")] * 40 + [("en", "w " * 120_000)]
    out = {r.phrase: tuple(r) for r in phrases.mine_phrases(spark.createDataFrame(docs, "lang string, text string")).collect()}
    assert {tuple(v) for v in out.values()} == {
        (p[0], p[1], p[1].count(" ") + 1, *p[2:]) for p in plain_phrases(docs, 4, 30, 80)
    }
    assert out["w w w w"][3:6] == (119_997, 120_000, 119_998)


def test_ranks_are_per_language_and_ties_go_by_phrase(spark):
    rows = [(lang, f"p{i:03d}", 5 + i % 3, 7 + i % 2) for lang in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long").repartition(6)
    got = {(r.lang, r.rank): r.phrase for r in phrases.top_phrases(df, 40).collect()}
    best = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[3], -r[2], r[1]))[:40]
    assert len(got) == 80 and [got["a", k + 1] for k in range(40)] == [r[1] for r in best]


def test_scores_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("9000000000000000000L AS a", "9000000000000000001L AS both")
    assert df.select(phrases._score(df.a, df.both)).first()[0] == 2_000_000 * 9_000_000_000_000_000_000 // 9_000_000_000_000_000_001


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.top_phrases(phrases.mine_phrases(empty)).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([(None, None)], empty.schema)).count() == 0

"""Shards by rendezvous hashing: shares, moves, slots, files, and rows that clash, repeat or lack a key."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding

TEXTS = [None, "", "a", "é 日本", "a", "x" * 200_000]


def documents(spark, n=300):
    rows = [(i, TEXTS[i % len(TEXTS)], "n", 1) for i in range(n)] + [(None, None, None, None)] * 5 + [(7, "a", "n", 2)] * 90
    return spark.createDataFrame(rows, "doc_id long, text string, size string, slot int").repartition(7)


def plain_shard(key, weights):
    bids = []
    for shard, weight in weights.items():
        digest = hashlib.md5(f"{'' if key is None else key}/{shard}".encode()).hexdigest()
        bids.append((math.log((int(digest[:13], 16) + 0.5) / 16.0**13) / weight, shard))
    return max(bids)[1]


def test_weighted_shares_and_moves(spark):
    weights = {0: 1.0, 3: 2.0, 8: 5.0}
    keys = spark.range(8000)
    more = {**weights, 9: 2.0}
    rows = keys.select("id", sharding.rendezvous(F.col("id"), weights).alias("a"), sharding.rendezvous(F.col("id"), more).alias("b")).collect()
    assert all(r.a == plain_shard(r.id, weights) for r in rows[:500])
    shares = collections.Counter(r.a for r in rows)
    assert all(abs(shares[s] / 8000 - w / 8.0) < 0.02 for s, w in weights.items())
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {9} and abs(len(moved) / 8000 - 0.2) < 0.02


def test_equal_weights_agree_with_the_general_rule(spark):
    rows = spark.range(500).select("id", sharding.rendezvous(F.col("id"), 7).alias("s")).collect()
    assert all(r.s == plain_shard(r.id, sharding.weights_of(7)) for r in rows)
    with pytest.raises(ValueError):
        sharding.weights_of({1: 0.0})
    with pytest.raises(ValueError):
        sharding.weights_of(0)


def test_manifest_has_every_row_once_and_slots_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 9)
    monkeypatch.setattr(sharding, "REPEATS_PER_PART", 4)
    docs = documents(spark)
    rows = sharding.manifest(docs, 4, 5).collect()
    whole = [(r.doc_id, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(whole)
    for shard in range(4):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows) and any(r.grown_shard == 4 for r in rows)
    assert all(r.shard == sharding_of(r.doc_id, 4) for r in rows)


def sharding_of(key, shards):
    return plain_shard(key, sharding.weights_of(shards))


def test_slots_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    docs = documents(spark)
    few = sorted(map(tuple, sharding.manifest(docs, 4, 5).collect()), key=repr)
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    assert sorted(map(tuple, sharding.manifest(docs.coalesce(2), 4, 5).collect()), key=repr) == few


def test_files_by_shard_hold_all_rows_and_columns(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "shards"), {1: 1.0, 2: 3.0})
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {"shard=1", "shard=2"}
    as_counts = lambda df: collections.Counter(map(tuple, df.select(*docs.columns).collect()))
    assert as_counts(back) == as_counts(docs)
    with pytest.raises(ValueError):
        sharding.assign(docs.withColumn("shard", F.lit(1)), 3)


def test_empty_table(spark):
    assert sharding.manifest(documents(spark).limit(0), 40, 41).count() == 0
    assert sharding.assign(documents(spark).limit(0), 40).count() == 0

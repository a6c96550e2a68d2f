"""Operator 11, phrases whose words belong together, by relational mining of sorted occurrences.

The relation of level k holds every place where a frequent phrase of k words begins, in the order of pieces and positions.
It is stored in blocks of whole documents: entry i is the number of the phrase that begins at place i, and a place
without one (the end of a piece, a rare word) has none, so neighbouring places are always in one piece. A level is
made from the one before:

1. merge-join of the relation with itself on piece and next position: a phrase of k words begins where two frequent ones of
   k - 1 words follow each other (all parts of a frequent phrase are frequent);
2. group-count: each block counts its own phrases and cuts them into parts by hash of (first part, last part), sorted and
   compressed; Spark groups by part and sums. The number of parts follows from what was counted, so a group has a bounded size;
3. semi-join: places of phrases that are not frequent are dropped before the next level. Frequent phrases are looked up in
   tasks while they are few (the bound is checked before), otherwise joined to the blocks.

Phrases are known by the numbers of their two parts, so counts are exact; hashes only deal them out. Only frequent ones
carry text. A very common phrase is one entry per block.

Null text: empty. Null language: ``und``. Null or repeated ids are documents of their own. Empty table: no rows. Texts are
whole, however long; a block is closed by the document that fills it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, batch
from tidemark.llm.spans import MULTIPLIERS, mix
from tidemark.session import cut_lineage, new_table_path

#: The ends of pieces, the language of texts without one, and the scale of the score.
PIECE_ENDS, NO_LANGUAGE, SCALE = b".,;:!?\n\x0b\x0c\r", "und", 2_000_000
LONGEST, MIN_COUNT, COVERED_PERCENT, TOP = 4, 30, 80, 2000
BLOCK_WORDS = 1_000_000
#: Phrases that a counting group holds, on average, and rows that are numbered together.
PART_PHRASES, PART_ROWS = 1_000_000, 500_000
#: Frequent words or phrases are looked up in tasks up to so many rows and bytes of text, else joined.
LOOKUP_WORDS, LOOKUP_PHRASES, LOOKUP_BYTES = 400_000, 3_000_000, 16 << 20
_END = b"\xff"  # no byte of UTF-8
_CLEAN = bytes.maketrans(UPPER.encode() + PIECE_ENDS, LOWER.encode() + _END * len(PIECE_ENDS))
_PAIRS = "block long, places binary, prefix array<long>, suffix array<long>, n array<long>"
#: The best rows of a language are taken in this many parts first.
_PARTS = 16


class _Numbers(dict):
    """Numbers of the words of one language in a block; the end of a piece is -1."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes]):
        super().__init__({_END: -1})
        self.lang, self.langs, self.words = lang, langs, words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.langs.append(self.lang)
        self.words.append(word)
        return number


class _Block:
    def __init__(self):
        self.langs, self.words, self.parts, self.size = [], [], [], 0
        self.by_lang: dict[str, _Numbers] = {}

    def add(self, lang: str, text: str) -> None:
        numbers = self.by_lang.get(lang)
        if numbers is None:
            numbers = self.by_lang[lang] = _Numbers(lang, self.langs, self.words)
        words = text.encode().translate(_CLEAN).replace(_END, b" \xff ").split()
        words.append(_END)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, block: int) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        n = np.bincount(places[places >= 0], minlength=len(self.words))
        words = [w.decode() for w in self.words]
        return batch(block=[block], places=pa.array([places.astype("<i4").tobytes()], pa.binary()),
                     lang=pa.array([self.langs], pa.list_(pa.string())), word=pa.array([words], pa.list_(pa.string())),
                     n=pa.array([n], pa.list_(pa.int64())))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, nth = _Block(), TaskContext.get().partitionId() << 33
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text")):
            block.add(lang.as_py(), text.as_py())
            if block.size >= BLOCK_WORDS:
                yield block.row(nth)
                block, nth = _Block(), nth + 1
    if block.size:
        yield block.row(nth)


def occurrences(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The stored relation of single words: ``block, places`` and, by number, ``lang, word, n`` inside the block."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "block long, places binary, lang array<string>, word array<string>, n array<long>"
    return _stored(rows.mapInArrow(_pack, schema))


def _stored(relation: DataFrame) -> DataFrame:
    path = new_table_path(relation.sparkSession, "places")
    relation.write.option("compression", "zstd").parquet(path)
    return relation.sparkSession.read.schema(relation.schema).parquet(path)


def _extend(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Phrases one word longer from blocks: their places, and the numbers and ids of their frequent phrases."""
    for block, places, number, ids in rows:
        if len(number):
            rank = np.full(int(places.max(initial=-1)) + 2, -1, np.int64)
            rank[number] = np.arange(len(number))
            kept = rank[places]  # -1 finds the last entry, which is -1
            at = np.flatnonzero(kept >= 0)
            left = at[:-1][at[1:] == at[:-1] + 1]
            pairs, phrase, n = np.unique(kept[left] * len(number) + kept[left + 1], return_inverse=True, return_counts=True)
            longer = np.full(len(places), -1, "<i4")
            longer[left] = phrase
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (ids[pairs // len(number)], ids[pairs % len(number)], n)]
            yield batch(block=[block], places=pa.array([longer.tobytes()], pa.binary()), prefix=lists[0], suffix=lists[1], n=lists[2])


def _joined(relation: DataFrame, key: list[str], frequent: DataFrame) -> DataFrame:
    """Longer phrases where the frequent ones are too many to look up: they are joined to what the blocks hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, places, found in zip(*(b.column(c) for c in ("block", "places", "frequent"))):
                number, ids = (found.values.field(f).to_numpy() for f in ("number", "id"))
                yield from _extend([(block.as_py(), np.frombuffer(places.as_py(), "<i4"), number, ids)])

    own = relation.select("block", F.posexplode(F.arrays_zip(*key)).alias("number", "row")).select("block", "number", "row.*")
    known = own.join(frequent.select(*key, "id"), key).groupBy("block").agg(F.collect_list(F.struct("number", "id")).alias("frequent"))
    return relation.select("block", "places").join(known, "block").mapInArrow(work, _PAIRS)


def _looked_up(relation: DataFrame, key: list[str], frequent: DataFrame) -> DataFrame:
    """Longer phrases with the frequent ones at hand in every task; nothing is shuffled."""
    table = frequent.select(*key, "id").toArrow()  # bounded: see extend
    ids = table["id"].to_numpy()
    if key == ["lang", "word"]:
        known = dict(zip(zip(table["lang"].to_pylist(), table["word"].to_pylist()), ids.tolist()))
    else:
        code = (table["prefix"].to_numpy() << 32) | table["suffix"].to_numpy()
        order = np.argsort(code)
        known = code[order], ids[order]
    shared = relation.sparkSession.sparkContext.broadcast(known)

    def ids_of(first: pa.Array, second: pa.Array) -> np.ndarray:
        if key == ["lang", "word"]:
            get = shared.value.get
            return np.array([get(k, -1) for k in zip(first.to_pylist(), second.to_pylist())], np.int64)
        codes, ids = shared.value
        mine = (first.to_numpy() << 32) | second.to_numpy()
        at = np.minimum(np.searchsorted(codes, mine), max(0, len(codes) - 1))
        return np.where(codes[at] == mine, ids[at], -1) if len(codes) else np.full(len(mine), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, places, first, second in zip(*(b.column(c) for c in ("block", "places", *key))):
                found = ids_of(first.values, second.values)
                number = np.flatnonzero(found >= 0)
                yield from _extend([(block.as_py(), np.frombuffer(places.as_py(), "<i4"), number, found[number])])

    return relation.select("block", "places", *key).mapInArrow(work, _PAIRS)


def extend(relation: DataFrame, key: list[str], frequent: DataFrame, last: bool = False) -> DataFrame:
    """The stored relation of the next length: ``block, places`` and, by number, ``prefix, suffix, n``.

    Only counts are asked of the ``last`` length, so its places are not stored.
    """
    text = F.sum(F.octet_length("word") + F.octet_length("lang")) if "word" in key else F.lit(0)
    size = frequent.agg(F.count("*").alias("rows"), text.alias("bytes"), F.max("id").alias("id")).first()
    few = size.rows <= (LOOKUP_WORDS if "word" in key else LOOKUP_PHRASES) and (size.bytes or 0) <= LOOKUP_BYTES
    build = _looked_up if few and (size.id or 0) < 1 << 31 else _joined
    longer = build(relation, key, frequent)
    return _stored(longer.drop("places") if last else longer)


def _word_counts(relation: DataFrame, key: list[str]) -> DataFrame:
    own = relation.select(F.explode(F.arrays_zip(*key, "n")).alias("row")).select("row.*")
    return own.groupBy(*key).agg(F.sum("n").alias("a"))


def _packed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """Counted pairs in ascending order as compressed planes of bytes, first parts as differences; and the bytes of a number."""
    width = 4 if max(prefix.max(initial=0), suffix.max(initial=0), n.max(initial=0)) < 1 << 32 else 8
    numbers = np.stack([np.diff(prefix, prepend=0), suffix, n]).astype(f"<u{width}")
    planes = numbers.view(np.uint8).reshape(3, len(n), width).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True), width


def _unpacked(pairs: bytes, rows: int, width: int) -> np.ndarray:
    """What ``_packed`` got, as three rows."""
    planes = np.frombuffer(pa.decompress(pairs, 3 * rows * width, codec="zstd", asbytes=True), np.uint8).reshape(3, width, rows)
    numbers = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<u{width}")[:, :, 0].astype(np.int64)
    np.cumsum(numbers[0], out=numbers[0])
    return numbers


def _phrase_counts(relation: DataFrame, least: int) -> DataFrame:
    """``prefix, suffix, a`` of all phrases found ``least`` times or more."""
    phrases = relation.agg(F.sum(F.size("n"))).first()[0] or 0
    parts = int(max(1, -(-phrases // PART_PHRASES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c) for c in ("prefix", "suffix", "n"))):
                prefix, suffix, n = (v.values.to_numpy() for v in row)
                order = np.lexsort((suffix, prefix)) if max(prefix.max(initial=0), suffix.max(initial=0)) >> 31 else np.argsort(prefix << 32 | suffix)
                mixed = mix(prefix.astype(np.uint64) * np.uint64(MULTIPLIERS[0]) + suffix.astype(np.uint64))
                part = (mixed % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
                order = order[np.argsort(part[order], kind="stable")]
                borders = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
                for some in np.split(order, borders[1:]):
                    if len(some):
                        pairs, width = _packed(prefix[some], suffix[some], n[some])
                        yield batch(part=pa.array([part[some[0]]], pa.int32()), rows=pa.array([len(some)], pa.int32()),
                                    width=pa.array([width], pa.int32()), pairs=pa.array([pairs], pa.binary()))

    def count(group: pa.Table) -> pa.Table:
        some = (group[c].to_pylist() for c in ("pairs", "rows", "width"))
        prefix, suffix, n = np.concatenate([_unpacked(*row) for row in zip(*some)], axis=1)
        first, rank = np.unique(prefix, return_inverse=True)
        room = int(suffix.max()) + 1
        code = rank * room + suffix
        order = np.argsort(code, kind="stable")
        borders = np.flatnonzero(np.diff(code[order], prepend=-1))
        a = np.add.reduceat(n[order], borders)
        code, a = code[order][borders][a >= least], a[a >= least]
        return pa.table({"prefix": first[code // room], "suffix": code % room, "a": a})

    dealt = relation.select("prefix", "suffix", "n").mapInArrow(deal, "part int, rows int, width int, pairs binary")
    return dealt.groupBy("part").applyInArrow(count, "prefix long, suffix long, a long")


def _numbered(counts: DataFrame, key: list[str]) -> DataFrame:
    """The stored counts with an ``id`` each, from 0 and almost without gaps: rows are numbered in parts by hash."""
    counts = cut_lineage(counts, "counts")
    parts = max(1, -(-counts.count() // PART_ROWS))
    part = F.pmod(F.xxhash64(*key), F.lit(parts))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*key)).cast("long") - 1
    return counts.withColumn("part", part).withColumn("id", nth * parts + F.col("part")).drop("part")


def frequent_words(relation: DataFrame, least: int) -> DataFrame:
    """``id, lang, word, a`` of words found ``least`` times or more, with what longer phrases take over from their parts."""
    counts = _numbered(_word_counts(relation, ["lang", "word"]).filter(F.col("a") >= least), ["lang", "word"])
    return cut_lineage(counts.select(
        "id", "lang", "word", F.col("word").alias("phrase"), F.col("word").alias("last"),
        "a", F.array("a").alias("heads"), F.array("a").alias("tails"),
    ), "phrases")


def frequent_phrases(relation: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Phrases found ``least`` times or more: ``heads[i]`` counts their first i + 1 words, ``tails[i]`` their last i + 1."""
    counts = _numbered(_phrase_counts(relation, least), ["prefix", "suffix"])
    first = parts.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"), "heads")
    rest = parts.select(F.col("id").alias("suffix"), "last", "tails")
    return cut_lineage(counts.join(first, "prefix").join(rest, "suffix").select(
        "id", "lang", "prefix", "suffix", F.concat_ws(" ", "begin", "last").alias("phrase"),
        "last", "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
    ), "phrases")


def _score(a: Column, both: Column) -> Column:
    """floor(SCALE * a / both) without rounding; the product may pass 64 bits."""
    wide = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", wide, both.cast("decimal(20,0)"))


def _lowest_cut(words: int) -> Column:
    """``score, cut, l, r`` of the lowest-scoring cut, ties to the smallest."""
    cuts = []
    for k in range(1, words):
        l, r = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        cuts.append(F.struct(_score(F.col("a"), l + r).alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def _uncovered(phrases: DataFrame, longer: DataFrame | None, percent: int) -> DataFrame:
    """Phrases without a longer candidate around them that has ``percent`` of their count.

    One word more is enough to look at: what lies between a phrase and a longer one is a candidate and counts no less.
    """
    if longer is None:
        return phrases
    around = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("around"))
    joined = phrases.join(around, "id", "left")
    return joined.filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))).drop("around")


def mine_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = MIN_COUNT,
    covered_percent: int = COVERED_PERCENT,
) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of all phrases of 2 to ``longest`` words found ``least`` times or more.

    Counts are per language; ``n`` counts its words. ``score`` is that of the lowest-scoring cut into two parts found ``l`` and
    ``r`` times. Phrases that a longer one covers in ``covered_percent`` of their places or more are left out.
    """
    relation, key = occurrences(docs, lang, text), ["lang", "word"]
    totals = _word_counts(relation, ["lang"]).withColumnRenamed("a", "n")
    levels = [frequent_words(relation, least)]
    for words in range(2, longest + 1):
        relation, key = extend(relation, key, levels[-1], words == longest), ["prefix", "suffix"]
        levels.append(frequent_phrases(relation, levels[-1], least))
    kept = []
    for words in range(2, longest + 1):
        left = _uncovered(levels[words - 1], levels[words] if words < longest else None, covered_percent)
        kept.append(left.select("lang", "phrase", F.lit(words).alias("words"), "a", _lowest_cut(words).alias("best")))
    every = reduce(DataFrame.unionByName, kept).join(totals, "lang")
    return every.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def top_phrases(phrases: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language by score, count and phrase, with their ``rank`` from 1.

    A language is cut into parts by hash whose first rows are found first, so that none is sorted by one task.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = parts.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth", "part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).filter(F.col("rank") <= most)

"""Operator 5, near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 64 values of 14 bits. Two signatures that differ in at most 27 values have, among 14 chunks, one that
differs in one value at most (pigeonhole: 14 * 2 > 27). Each chunk is filed once for every value that may
be wrong, with that value masked; so every pair within the distance meets in a bucket. A pair of Jaccard
similarity 0.8 lies beyond the distance with a probability of about 1e-5. Pairs are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, id_and_text, lean, text_bytes, text_slices
from tidemark.llm.components import components
from tidemark.llm.spans import mix, span_hashes
from tidemark.session import cut_lineage

#: Words of a shingle, unless the caller says otherwise.
SHINGLE = 5
VALUES, BITS, CHUNKS = 64, 14, 14
DISTANCE = 27
PERCENT = 80
#: Tasks that share the documents holding one shingle.
SALTS = 8
_FOLD = np.uint64(0x9FB21C651E98DF25)
_PIECE = 1 << 22
_LONG_WORD = 1 << 13


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are split at ASCII blanks, A-Z in lower case."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield from _sets(buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
        i = j


def _sets(text: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(text))]
    opens[borders] = inside[borders]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[borders - 1] = inside[borders - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = np.zeros(len(start), np.uint64)
    short = end - start < _LONG_WORD
    words[short] = span_hashes(text, start[short], end[short])
    for k in np.flatnonzero(~short):  # in steps, each mixed into the hash so far
        cut = np.arange(start[k], end[k], _LONG_WORD)
        for h in span_hashes(text, cut, np.minimum(cut + _LONG_WORD, end[k])):
            words[k] = mix(words[k : k + 1] * _FOLD + h)[0]
    first = np.searchsorted(start, offsets)
    folded = words.copy()
    for k in range(1, size):
        folded[: len(words) - k] = mix(folded[: len(words) - k] * _FOLD + words[k:])
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(folded[a : b - size + 1])
        elif b > a:  # the whole sequence, marked with its length
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * _FOLD + words[k : k + 1])
            yield mix(h ^ np.uint64(b - a))
        else:
            yield words[:0]


def signature(shingles: np.ndarray, xors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """``VALUES`` minima under seeded hashes, cut to ``BITS`` bits."""
    least = np.full(len(xors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        some = shingles[None, i : i + 2048]
        least = np.minimum(least, ((some ^ xors[:, None]) * factors[:, None]).min(axis=1))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _pack(values: np.ndarray) -> np.ndarray:
    """Four values in a long, with a spare bit above each."""
    lanes = values.reshape(len(values), -1, 4)
    return (lanes << (np.arange(4) * (BITS + 1))).sum(axis=2)


def _describe(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(2 * VALUES)
        xors, factors = seeds[:VALUES], seeds[VALUES:] | np.uint64(1)
        for b in batches:
            for i, j in text_slices(b.column("text")):
                sizes, prints, values = [], [], []
                for s in shingle_sets(*text_bytes(b.column("text").slice(i, j - i)), size):
                    sizes.append(len(s))
                    prints.append((mix(s * _FOLD).sum(dtype=np.uint64), mix(s ^ _FOLD).sum(dtype=np.uint64)))
                    values.append(signature(s, xors, factors))
                packed = _pack(np.stack(values))
                prints = np.array(prints, np.uint64).view(np.int64)
                ends = np.arange(len(sizes) + 1, dtype=np.int32) * packed.shape[1]
                yield batch(
                    doc_id=b.column("doc_id").slice(i, j - i), n_shingles=pa.array(sizes, pa.int64()), f1=prints[:, 0], f2=prints[:, 1],
                    signature=pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.ravel())),
                )

    return lean(rows)


def _sets_of(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column("text")):
                sets = list(shingle_sets(*text_bytes(b.column("text").slice(i, j - i)), size))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield batch(node=b.column("doc_id").slice(i, j - i), shingles=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return lean(rows)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for each chunk and each value of it that may be wrong; its low bits name that value."""
    tags = _seeds(VALUES)
    for b in batches:
        packed = b.column("signature").flatten().to_numpy().reshape(b.num_rows, -1)
        values = ((packed[:, :, None] >> (np.arange(4) * (BITS + 1))) & ((1 << BITS) - 1)).reshape(b.num_rows, -1)
        keys = []
        for chunk in np.array_split(np.arange(VALUES), CHUNKS):
            for masked in chunk:
                key = np.full(b.num_rows, tags[masked], np.uint64)
                for k in chunk[chunk != masked]:
                    key = mix(key * _FOLD + values[:, k].astype(np.uint64))
                keys.append((key & ~np.uint64(VALUES - 1) | np.uint64(masked)).view(np.int64))
        node = b.column("node").to_numpy()
        yield batch(key=np.concatenate(keys), node=np.tile(node, VALUES))


def distance(a: Column, b: Column) -> Column:
    """Number of values in which two packed signatures differ: a lane that differs carries into its spare bit."""
    ones = sum(((1 << BITS) - 1) << (lane * (BITS + 1)) for lane in range(4))
    spare = sum(1 << (BITS + lane * (BITS + 1)) for lane in range(4))
    total = F.lit(0)
    for i in range(VALUES // 4):
        differ = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        total = total + F.bit_count((differ + F.lit(ones)).bitwiseAND(F.lit(spare)))
    return total


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs within the signature distance whose set sizes allow the similarity."""
    a = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    b = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    joined = pairs.join(a, "a").join(b, "b")
    return joined.filter(sizes & (distance(F.col("sa"), F.col("sb")) <= DISTANCE)).select("a", "b")


class _Links:
    """Confirmed links so far, the components they make, and the shingle sets read for that."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int):
        self.rows, self.nodes, self.links, self.shingle, self.sets = rows, nodes, links, shingle, None
        self.found = components(links)

    def read_sets(self, wanted: DataFrame) -> bool:
        """Have the shingle sets of the documents ``wanted (node)`` at hand; False if there are none at all."""
        wanted = wanted.select(F.col("node").alias("doc_id")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
        wanted = cut_lineage(wanted, "wanted")
        if not wanted.isEmpty():
            read = self.rows.join(wanted, "doc_id").mapInArrow(_sets_of(self.shingle), "node long, shingles array<long>")
            read = cut_lineage(read, "shingle-sets")
            self.sets = read if self.sets is None else self.sets.unionByName(read)
        return self.sets is not None

    def _more(self, links: DataFrame) -> None:
        self.links = self.links.unionByName(cut_lineage(links, "confirmed"))
        self.found = components(self.links)

    def add_pairs(self, pairs: DataFrame) -> None:
        """Confirm candidate pairs on their whole shingle sets."""
        near = cut_lineage(_near(pairs, self.nodes), "near")
        if not self.read_sets(near.select(F.explode(F.array("a", "b")).alias("node"))):
            return
        a, b = self.sets.toDF("a", "sa"), self.sets.toDF("b", "sb")
        both = near.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        union = F.size("sa") + F.size("sb") - F.col("common")
        self._more(both.filter(100 * F.col("common") >= PERCENT * union).select("a", "b").distinct())

    def add_across(self, members: DataFrame) -> None:
        """Find and confirm all links between components, inside the buckets ``members (key, node)``.

        A shingle that only one component holds cannot be common to a pair looked for here. The number of other
        shingles of a document, and the smallest set of its bucket, bound its similarity to any partner there; most documents
        leave by that. What stays is joined on the bucket and confirmed in the join, so pairs are never rows.
        """
        own = self.found.select(F.col("node").alias("n"), F.col("component").alias("c"))
        live = members.join(own, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("c", "node").alias("c"))
        live = cut_lineage(_mixed(cut_lineage(live, "placed")), "live")
        of = live.select("node", "c").distinct()
        if not self.read_sets(of):
            return
        held = of.join(self.sets, "node").select("node", "c", F.explode("shingles").alias("s"))
        held = cut_lineage(held, "held")
        common = held.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        salted = held.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        useful = salted.join(common.select("s", salts.alias("salt")), ["s", "salt"])
        useful = useful.groupBy("node").agg(F.collect_list("s").alias("useful"))  # at most the set of one document
        parts = of.join(useful, "node").join(self.nodes, "node")
        parts = cut_lineage(parts.select("node", "c", "n_shingles", "signature", "useful", F.size("useful").alias("u")), "parts")

        sized = live.select("key", "node").join(parts.select("node", "c", "n_shingles", "u"), "node")
        bounds = sized.groupBy("key").agg(F.min("n_shingles").alias("least"), F.max("u").alias("most"))
        sized = sized.join(bounds, "key").withColumn("m", F.least("u", "most"))
        able = sized.filter(100 * F.col("m") >= PERCENT * (F.col("n_shingles") + F.greatest("least", "m") - F.col("m")))
        able = cut_lineage(_mixed(able.select("key", "node", "c")), "able")
        full = able.select("key", "node").join(parts, "node").select("key", "node", "c", "n_shingles", "u", "signature", "useful")
        x, y = full.alias("x"), full.alias("y")
        col = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
        (na, nb), (ua, ub), (sa, sb) = col("n_shingles"), col("u"), col("signature")
        bound = (100 + PERCENT) * F.least(ua, ub) >= PERCENT * (na + nb)
        cheap = (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & bound
        near = _filed_once(F.col("x.key"), sa, sb) & (distance(sa, sb) <= DISTANCE)
        alike = (100 + PERCENT) * F.size(F.array_intersect("x.useful", "y.useful")) >= PERCENT * (na + nb)
        confirmed = F.when(cheap, F.when(near, alike).otherwise(False)).otherwise(False)
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & confirmed)
        self._more(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of ``members (key, node, c)`` whose bucket holds several components."""
    several = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    return members.join(several.select("key"), "key")


def _filed_once(key: Column, a: Column, b: Column) -> Column:
    """Of a chunk that is equal as a whole, and so filed alike under each of its values, only the first counts."""
    masked = key.bitwiseAND(F.lit(VALUES - 1)).cast("int")
    lane = F.floor(masked / 4).cast("int")
    differ = F.get(a, lane).bitwiseXOR(F.get(b, lane))
    mask = F.array(*[F.lit(((1 << BITS) - 1) << (i * (BITS + 1))) for i in range(4)])
    wrong = differ.bitwiseAND(F.get(mask, masked % 4)) != 0
    return wrong | masked.isin([int(chunk[0]) for chunk in np.array_split(np.arange(VALUES), CHUNKS)])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Linked are documents whose sets of shingles of so many words share 80 of 100 or more. Documents of equal sets are one node.
    Each document is first compared with one leader of every bucket it is in: the member that meets the most others,
    as the original of many copies does; so large groups join without pairs of all with all. Buckets that then still hold several
    components are searched for links across components (``_Links.add_across``); pairs inside a component could not change the result.

    Texts without words have no shingles and no links; shorter texts are one shingle. Rows with one ``doc_id`` count as one
    document. Rows without ``doc_id`` have no component and are kept. An empty table gives an empty one.
    """
    rows = id_and_text(docs)
    described = cut_lineage(
        rows.mapInArrow(_describe(shingle), "doc_id long, n_shingles long, f1 long, f2 long, signature array<long>"), "signatures"
    )
    print_ = ["n_shingles", "f1", "f2"]
    linked = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(linked.groupBy(*print_).agg(F.min("doc_id").alias("node")), "classes")
    mine = [F.col(c).alias(f"c_{c}") for c in print_]
    first = classes.select("node", *mine).join(described, F.col("node") == F.col("doc_id"))
    same = (F.col("n_shingles") == F.col("c_n_shingles")) & (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2"))
    nodes = cut_lineage(first.filter(same).select("node", "signature", "n_shingles").distinct(), "nodes")

    filed = nodes.select("node", "signature").mapInArrow(lean(_file), "key long, node long")
    buckets = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(filed.join(cut_lineage(buckets, "buckets"), "key"), "members")
    # a document id may stand for several classes, if rows repeat it
    again = linked.join(classes.withColumnRenamed("node", "a"), print_).filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    repeated = again.join(classes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    state = _Links(rows, nodes, cut_lineage(repeated.distinct(), "repeated"), shingle)
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    led = members.join(weighed, "key").filter("node <> leader")
    state.add_pairs(led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
    state.add_across(members.select("key", "node"))
    found = state.found

    member = described.join(classes, print_, "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return member.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows whose document stands for its group, with all their columns."""
    kept = near_duplicates(docs, shingle).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")

"""Operator 2, byte-level BPE by tree reduction.

A match of the split pattern is encoded by halves. Two neighbours are joined by re-encoding a window
around their border, which grows until the tokens next to it on both sides stay as they are. A sequence
of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of their own
bytes; so once both ends of the window fit their outer neighbours, all tokens outside are final.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LONG_WORD, PartEncoder, batch, id_and_text, lean, text_slices, worker_store

LEAF = 24
WINDOW = 2
#: Matches remembered beside the whole words that PartEncoder remembers.
MATCH_ENTRIES = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBPE:
    """Encoder and decoder for one table of ranks; ``neighbours`` remembers which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = dict(zip(ranks.values(), ranks.keys()))
        self.neighbours: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def fits(self, a: int, b: int) -> bool:
        known = self.neighbours.get((a, b))
        if known is None:
            if len(self.neighbours) > 500_000:
                self.neighbours.clear()
            known = self.neighbours[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.leaf(b"".join(map(self.token.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.fits(left[i - 1], middle[0])) and (j == len(right) or self.fits(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match: leaves of a few bytes, joined pairwise up the tree (without recursion, so of any length)."""
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)] if piece not in self.ranks else [[self.ranks[piece]]]
        while len(level) > 1:
            joined = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]
            level = joined + level[len(joined) * 2 :]
        return level[0] if level else []

    def encode(self, text: str) -> list[int]:
        return [i for match in self.split(text) for i in self.piece(match.encode())]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: blocks of ids are looked up, then concatenated up the tree."""
        token = self.token.__getitem__
        level = [b"".join(map(token, ids[i : i + 65536].tolist())) for i in range(0, len(ids), 65536)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def _encoder(ranks: dict[bytes, int], pattern: str) -> tuple[ByteBPE, PartEncoder]:
    """The worker's encoder; words it has seen are remembered up to a bound."""
    store = worker_store("bpe")
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if store.get("key") != key:
        store.clear()
        store["key"], store["model"] = key, ByteBPE(ranks, pattern)
    model = store["model"]

    known = store.setdefault("matches", {})

    def encode_all(parts: list[str]) -> list[bytes]:
        if len(known) > MATCH_ENTRIES:
            known.clear()
        out = []
        for part in parts:
            matches = model.split(part)
            for m in matches:
                if m not in known:
                    known[m] = np.array(model.piece(m.encode()), "<u4").tobytes()
            out.append(b"".join([known[m] for m in matches]))
            if len(part) > LONG_WORD:
                for m in matches:
                    known.pop(m, None)
        return out

    return model, PartEncoder(store, encode_all)


def packed_ids(encoder: PartEncoder, texts: pa.Array) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    ids, first = encoder.encode(texts)
    raw, at = ids.tobytes(), (4 * first).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:])]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``, the packed little-endian 32-bit ids of each whole text.

    Null and empty texts have no ids; rows are encoded one by one, so repeated rows repeat; an empty
    table gives an empty one. The rank file (under a few MB, a fixed vocabulary) is read once on the
    driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or _encoder(ranks.value, pattern)[1]
            for i, j in text_slices(b.column("text")):
                packed = packed_ids(encoder, b.column("text").slice(i, j - i))
                yield batch(doc_id=b.column("doc_id").slice(i, j - i), ids=pa.array(packed, pa.binary()))

    return id_and_text(docs).mapInArrow(lean(encode, "bpe"), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and ``decoded``, the bytes of packed ids; null ids are none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or ByteBPE(ranks.value, ".")
            for i in range(0, b.num_rows, 512):
                ids = b.column("ids").slice(i, 512).to_pylist()
                yield batch(
                    doc_id=b.column("doc_id").slice(i, len(ids)),
                    decoded=pa.array([model.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary()),
                )

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(decode, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder = None
        for b in batches:
            if encoder is None:
                model, encoder = _encoder(ranks.value, pattern)
            for i, j in text_slices(b.column("text")):
                packed = packed_ids(encoder, b.column("text").slice(i, j - i))
                yield batch(
                    doc_id=b.column("doc_id").slice(i, j - i),
                    n_tokens=pa.array([len(x) // 4 for x in packed], pa.int64()),
                    ids_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    decoded_sha256=pa.array(
                        [hashlib.sha256(model.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in packed], pa.string()
                    ),
                )

    return id_and_text(docs).mapInArrow(lean(both, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

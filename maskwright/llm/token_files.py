"""Token-id files: fixed-size id blocks, transposed to byte or bit planes, zstandard a plane.

A file set is a Parquet table of *segments*, so Spark's commit protocol covers it on any
file system that Spark writes. A segment holds whole documents. Its columns:

``part, segment``  place of the segment; (part, segment) ascending is document order
``first_id``       ids before the segment within its part
``n_ids``          ids in the segment
``doc_ids``        keys of its documents, in order (null keys stay null)
``doc_lens``       number of ids of each document, its end id included
``chunk_index``    for each block of ``block_ids`` ids: byte offset of each plane in ``data``
``data``           the compressed planes, one after the other

Block ``b`` holds ids ``b * block_ids`` up to the next block's or the segment's end, as
little-endian unsigned 32-bit integers. In byte planes, plane ``k`` has byte ``k`` of every
id; in bit planes, plane ``k`` has bit ``k`` of every id, packed eight to a byte, lowest
first, zero-padded. A plane without a set bit has length 0.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shared_path, slices, tidy
from .shingles import BLOCK, span_hashes, utf8

SEGMENT_IDS = 1 << 19
BLOCK_IDS = 1 << 15
END_ID = 2
#: Bytes of text encoded at once, about.
SLICE = 1 << 20
#: Entries of a worker's table of text pieces; at the limit it starts afresh.
MEMO = 1_500_000

_SCHEMA = (
    "part int, segment int, first_id bigint, n_ids bigint, doc_ids array<bigint>, "
    "doc_lens array<bigint>, chunk_index array<array<int>>, data binary"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
    ("chunk_index", pa.list_(pa.list_(pa.int32()))), ("data", pa.binary()),
])


# --- planes -------------------------------------------------------------------------------
def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of a block of ids, uncompressed; empty where no bit is set."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    elif kind == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    else:
        raise ValueError(f"planes are byte or bit, not {kind}")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Inverse of :func:`to_planes`: 4 planes are byte planes, 32 are bit planes."""
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = 1) -> tuple[list[list[int]], bytes]:
    """Chunk index and data of a segment's ids."""
    squeeze, index, data, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for b in range(0, len(ids), block_ids):
        offsets = []
        for plane in to_planes(ids[b : b + block_ids], kind):
            offsets.append(at)
            if plane:
                data.append(squeeze.compress(plane))
                at += len(data[-1])
        index.append(offsets)
    return index, b"".join(data)


def unpack(index: list[list[int]], data: bytes, n_ids: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Ids of a segment, exactly as given to :func:`pack`."""
    expand, ends = zstandard.ZstdDecompressor(), [o for offsets in index for o in offsets][1:] + [len(data)]
    out, k = [], 0
    for b, offsets in enumerate(index):
        planes = []
        for o in offsets:
            planes.append(expand.decompress(data[o : ends[k]]) if ends[k] > o else b"")
            k += 1
        out.append(from_planes(planes, min(block_ids, n_ids - b * block_ids)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# --- text to ids --------------------------------------------------------------------------
#: Kinds of ASCII bytes: 1 letter, 2 digit, 3 other visible, 4 apostrophe, 5 white space. Others are 0.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[39], _KIND[[9, 10, 11, 12, 13, 32]] = 3, 2, 4, 5
_KIND[65:91] = _KIND[97:123] = 1
#: Whether a token of the byte-level pattern always ends between bytes of two kinds.
_ENDS = np.zeros((6, 6), bool)
_ENDS[1, 2:] = _ENDS[2, [1, 3, 4, 5]] = _ENDS[3, [1, 2, 5]] = _ENDS[4, [2, 5]] = True
#: First bytes of characters that are surely no white space: all but those of U+0085, U+00A0 and some at U+1680 to U+3000.
_SOLID = (_KIND > 0) & (_KIND < 5)
_SOLID[[0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF5)]] = True


class PieceEncoder:
    """``tokenizers`` encoding of whole texts, by a bounded table of their pieces.

    Texts are cut only where the byte-level pre-tokenizer ends a token whatever follows or
    came before: between ASCII letters, digits and signs, before a space that a non-space
    follows, and around a lone line feed. Pieces are told apart by 64-bit hashes, for all
    texts at once; those that the table lacks are encoded by the library. Texts with the
    content of an added token go through the library as a whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        """Hashes, ascending, with the number of each; where the ids of a number begin, and how many it has."""
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.length, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, "<u4"), 0
        self.recent: dict[int, int] = {}

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of distinct hashes; -1 if not in the table."""
        if not len(self.hashes):
            out = np.full(len(h), -1, np.int64)
        else:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.numbers[at], -1)
        miss = np.flatnonzero(out < 0)
        out[miss] = [self.recent.get(x, -1) for x in h[miss].tolist()]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        k, n = len(self.hashes) + len(self.recent), len(ids)
        sizes = np.array([len(x) for x in ids])
        need = self.used + int(sizes.sum())
        if k + n > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * (k + n)), np.resize(self.length, 2 * (k + n))
        if need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * need)
        self.ids[self.used : need] = [i for x in ids for i in x]
        self.begin[k : k + n], self.length[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used = need
        self.recent.update(zip(hashes.tolist(), range(k, k + n)))
        if len(self.recent) > 1 << 16:
            h = np.concatenate([self.hashes, np.fromiter(self.recent.keys(), np.uint64)])
            numbers = np.concatenate([self.numbers, np.fromiter(self.recent.values(), np.int32)])
            order = np.argsort(h)
            self.hashes, self.numbers, self.recent = h[order], numbers[order], {}

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of a block, one after the other, and how many each has."""
        if len(self.hashes) > MEMO:
            self._clear()
        h, first, of = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        k = self._numbers(h)
        new = np.flatnonzero(k < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(h[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            k = self._numbers(h)
        k = k[of]
        sizes = self.length[k]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.ids[np.repeat(self.begin[k] - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = utf8(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        kind, solid, cut = _KIND[data], _SOLID[data], np.zeros(len(data), bool)
        cut[1:] = _ENDS[kind[:-1], kind[1:]]
        cut[:-1] |= (data[:-1] == 32) & solid[1:]
        cut[2:] |= solid[:-2] & (kind[:-2] > 0) & (data[1:-1] == 10) & solid[2:]
        cut[bounds[1:][bounds[1:] > 0] - 1] = False  # the next text's first byte does not count
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        ids, sizes, at = [], [], 0
        while at < len(starts):
            to = int(np.searchsorted(ends, starts[at] + BLOCK, "right"))
            if to == at:  # one piece longer than a block
                own = self.tokenizer.encode(data[starts[at] : ends[at]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
                got, to = (np.array(own, "<u4"), np.array([len(own)])), at + 1
            else:
                got = self._block(data[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at])
            ids.append(got[0])
            sizes.append(got[1])
            at = to
        of = np.searchsorted(bounds, starts, "right") - 1
        return np.concatenate(ids), np.bincount(of, np.concatenate(sizes), len(texts)).astype(np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with its end id, and how many each has; null is empty."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        ids, counts = self._plain(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end_id, "<u4")
        counts = counts + 1
        own = np.ones(len(out), bool)
        own[np.cumsum(counts) - 1] = False
        out[own] = ids
        return out, counts


@lru_cache(1)
def _encoder(path: str | None) -> PieceEncoder:
    """The encoder of a worker, whose table its next tasks find filled."""
    return PieceEncoder(path)


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = END_ID,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every text of ``df`` and write the ids at ``path``, in ascending order of ``key``.

    One range exchange on the key; each task sorts, encodes and packs its own range, so no
    task needs another's result, and a lost task is simply run again. Null text: no ids but
    the end id. Null keys come first; equal keys and repeated rows all stay, ordered by text.
    An empty table writes no segment. Other columns are not read.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        keys, lens, held, before, number = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            index, data = pack(ids, block_ids, planes)
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": number, "first_id": before, "n_ids": len(ids), "doc_ids": keys,
                "doc_lens": lens, "chunk_index": index, "data": data,
            }], schema=_ARROW)

        for batch in batches:
            for rows in slices(batch, "t", SLICE):
                ids, counts = encoder.encode(rows.column("t"), end_id)
                keys += rows.column("k").to_pylist()
                lens += counts.tolist()
                held.append(ids)
                if sum(map(len, held)) >= segment_ids:
                    yield closed()
                    before, number, keys, lens, held = before + sum(map(len, held)), number + 1, [], [], []
        if keys:
            yield closed()

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    # Equal rows are told apart by a random number, so that they can lie in several ranges.
    rows = rows.withColumn("r", F.rand(11)).repartitionByRange(F.col("k"), F.crc32("t"), "r").sortWithinPartitions("k", F.crc32("t"), "t")
    with tidy(df.sparkSession):
        rows.mapInArrow(segments, _SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, with_ids: bool = True) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = unpack(r["chunk_index"], r["data"], r["n_ids"], block_ids)
                ends = np.cumsum(r["doc_lens"], dtype=np.int64)
                starts, raw = ends - np.array(r["doc_lens"], np.int64), memoryview(ids.tobytes())
                cols = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(starts + (r["first_id"] + r["base"])),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    segments = spark.read.schema(_SCHEMA).parquet(path)
    # One row for each writing task: a table as small as the number of files.
    parts = segments.groupBy("part").agg(F.max(F.col("first_id") + F.col("n_ids")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(parts), "part").mapInArrow(documents, schema)


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder, read them back, and give their digest."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id=end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)

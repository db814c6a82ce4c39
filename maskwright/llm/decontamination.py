"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions: some count, some are ignored. Equal hashes of a
mask at a place in a benchmark item and a place in a document are a hit even if the tokens at
ignored positions differ. Around each hit the two texts are compared token by token on the
same diagonal; the best-scoring stretch counts as overlap if it is long and similar enough,
and else the longest one on the diagonal that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed masks: 1 counts, 0 is ignored. Each has four ones: every four of five tokens. No overlap
#: by the rule below is without a hit: a text that avoids all four masks has too few equal tokens.
MASKS = ("1111", "10111", "11011", "11101")
#: An overlap has so many equal tokens, or this share of a shorter item, and this share of equal tokens.
LEAST_EQUAL, LEAST_OF_ITEM, LEAST_SHARE = 12, 0.8, 0.75
#: Items with fewer tokens than the shortest mask are compared as a whole run of tokens.
#: Benchmark tokens held by a task at once; more are handled block by block, each against all documents.
BLOCK_TOKENS = 2_000_000

_token = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; none for null."""
    return _token(text.lower()) if text else []


class SeedIndex:
    """Seed hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, tokens(t)) for i, t in items]
        self.vocabulary: dict[str, int] = {}
        for _, ts in self.items:
            for t in ts:
                self.vocabulary.setdefault(t, len(self.vocabulary) + 1)
        rng = np.random.default_rng(3)
        longest = max(map(len, MASKS))
        self.factors = rng.integers(1, 2**63, size=(len(MASKS), longest), dtype=np.uint64) | np.uint64(1)
        self.ids = [np.fromiter(map(self.vocabulary.__getitem__, ts), np.uint64, len(ts)) for _, ts in self.items]
        # Short items: a mask of their own length, so that they are found when whole.
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
        self.short = sorted({len(x) for x in self.ids if 0 < len(x) < len(MASKS[0])})
        self.short_factors = rng.integers(1, 2**63, size=len(MASKS[0]), dtype=np.uint64) | np.uint64(1)
        hashes, where, places = [], [], []
        for k, x in enumerate(self.ids):
            for h, at in self.seeds(x, own=True):
                hashes.append(h)
                where.append(np.full(len(at), k))
                places.append(at)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.where = (np.concatenate(where) if where else np.zeros(0, int))[order]
        self.places = (np.concatenate(places) if places else np.zeros(0, int))[order]

    def seeds(self, x: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and places of each mask over token numbers ``x``, where no counted token is 0."""
        for k, at in enumerate(self.masks):
            n = len(x) - int(at[-1])
            if n > 0:
                yield self._hash(x, at, self.factors[k], n)
        lengths = [len(x)] * (0 < len(x) < len(MASKS[0])) if own else self.short
        for size in lengths:
            n = len(x) - size + 1
            if n > 0:
                h, at = self._hash(x, np.arange(size), self.short_factors, n)
                yield h ^ np.uint64(size), at

    @staticmethod
    def _hash(x: np.ndarray, at: np.ndarray, factors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        live = x[at[0] : at[0] + n] != 0
        for a in at[1:]:
            live = live & (x[a : a + n] != 0)
        places = np.flatnonzero(live)
        h = np.zeros(len(places), np.uint64)
        for a, f in zip(at, factors):
            h = (h ^ (x[places + a] * f)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h, places

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, first token, last token + 1, first token of the item, equal tokens): the best of each item."""
        ts = tokens(text)
        x = np.fromiter(map(self.vocabulary.get, ts, repeat(0)), np.uint64, len(ts))
        if not len(self.hashes):
            return []
        diagonals = set()
        for h, at in self.seeds(x):
            if len(h):
                lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                for j in np.flatnonzero(hi > lo):
                    w = slice(lo[j], hi[j])
                    diagonals.update(zip(self.where[w].tolist(), (int(at[j]) - self.places[w]).tolist()))
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for k, d in sorted(diagonals):
            got = self._stretch(x, self.ids[k], d)
            if got:
                first, last, equal = got
                item, row = self.items[k][0], (equal, d + first, d + last, first)
                if k not in best or row[0] > best[k][4]:
                    best[k] = (item, row[1], row[2], row[3], equal)
        return [best[k] for k in sorted(best)]

    @staticmethod
    def _stretch(x: np.ndarray, y: np.ndarray, d: int) -> tuple[int, int, int] | None:
        """A stretch of item ``y`` on diagonal ``d`` of ``x`` that is an overlap, or None if there is none.

        The one with the most equal minus unequal tokens if that is one, else that with the most equal tokens.
        """
        a, b = max(0, -d), min(len(y), len(x) - d)
        if b <= a:
            return None
        same = x[a + d : b + d] == y[a:b]
        # Greatest sum of +1 and -1.5 over a stretch: running sums against their least so far.
        sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -1.5))])
        least = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - least))
        start = int(np.argmin(sums[: end + 1]))
        equal = int(same[start:end].sum())
        need = min(LEAST_EQUAL, int(np.ceil(LEAST_OF_ITEM * len(y))))
        if end > start and equal >= need and equal >= LEAST_SHARE * (end - start):
            return a + start, a + end, equal
        if int(same.sum()) < need:
            return None
        # Running sums of +1 - share and -share: a stretch has the share if its sum is not negative.
        # For each end, the first start whose sum is not greater has the most equal tokens.
        count = np.concatenate([[0], np.cumsum(same)])
        sums = count - LEAST_SHARE * np.arange(len(count))
        starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
        end = int(np.argmax(count - count[starts]))
        start, equal = int(starts[end]), int(count[end] - count[starts[end]])
        if equal < need:
            return None
        inside = np.flatnonzero(same[start:end])
        return a + start + int(inside[0]), a + start + int(inside[-1]) + 1, equal


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[list[tuple[int, str | None]]]:
    """Benchmark items in blocks of about ``block_tokens`` tokens, each small enough for a task."""
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(chars) // (5 * block_tokens)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark if n == 1 else benchmark.where(part == k)
        yield [(r["item_id"], r["text"]) for r in rows.select("item_id", "text").orderBy("item_id", "text").collect()]


def overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, first_token, end_token, item_token, n_equal.

    Documents without overlap have no row. Null texts and items have no token and overlap
    nothing; repeated documents each have their rows; equal items each count.
    """
    out = None
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, block_tokens):
        held = sc.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(held.value)
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(d, *o) for o in index.overlaps(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "first_token", "end_token", "item_token", "n_equal"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            found, "doc_id bigint, item_id bigint, first_token bigint, end_token bigint, item_token bigint, n_equal bigint")
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns, by one pass a block."""
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, block_tokens):
        held = sc.broadcast(block)

        def kept(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(held.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.overlaps(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs

"""Exact Jaccard self-join of documents on word shingles, by prefixes under several token orders.

Sort the shingles (tokens) of all sets by one order of the whole corpus. If the first token
that sets A and B share stands at place i of A and j of B, they share at most
``min(|A| - i, |B| - j)``; for a link that must reach ``0.8 / 1.8 * (|A| + |B|)``. So linked
sets share a token near the start of both, whatever the order, and only pairs that do so under
*every* one of several orders are compared.

All orders put rare tokens first, by exact document frequencies; they differ in how finely
they tell frequencies apart, and in the hash that breaks ties. A token of only one document
shares nothing, so it needs a place but no posting, and a set with too many of them links
with nothing at all.

1. Each task shingles its texts in *cells* of bounded size and deals each cell's distinct
   tokens out by ranges of their hash. A range's group counts tokens over all cells and sends
   those of two documents or more back to their cells. A token that several documents of a
   cell have is sent once, with its count, so a hot token costs a group one entry a cell.
2. A cell then knows the repeated tokens of each set. It keeps them, and the set's prefix
   under each order, unless the set cannot link.
3. Equal sets become one class; only its least document takes part.
4. Sets with the same least hash are compared with the least document of them: stars, which
   connect most near copies at one comparison each.
5. Prefixes are joined, but only between *different* components: in a token's list, the
   documents outside the largest component meet the others, those within it don't meet each
   other. Pairs found under all orders are compared exactly on their repeated tokens.

Step 5 covers every pair of classes not connected in step 4, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, written
from .shingles import mixed, shingles

#: Links: 100 * intersection >= SHARE * union.
SHARE = 80
#: Token orders whose prefixes must all meet, and hash functions whose least values form stars.
ORDERS = 3
STARS = 4
#: Tokens and documents of a cell, and bytes of text for each range of token hashes, about.
CELL_TOKENS = 1 << 19
CELL_DOCS = 60_000
RANGE_BYTES = 8 << 20
#: Stands for "several documents of the cell" where a document's number in its cell is told.
_SEVERAL = 0xFFFF
_U = np.uint64


def prefix_length(n):
    """Places of a set of ``n`` where the first token shared with a linked set can be: n - ceil(SHARE n / 100) + 1."""
    return n - -(-SHARE * n // 100) + 1


# --- cells: tokens out, repeated tokens back -----------------------------------------------
_DEALT = pa.schema([("range", pa.int32()), ("cell", pa.int64()), ("sets", pa.binary()), ("tokens", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_DEALT_DDL = "range int, cell bigint, sets binary, tokens binary, docs binary, counts binary"
#: Of each document of a cell: key, whether it has one, set size, set fingerprint, least hashes.
_SETS = np.dtype([("doc_id", "<i8"), ("known", "?"), ("n", "<i8"), ("f1", "<u8"), ("f2", "<u8"), ("least", "<u8", (STARS,))])


def _packed(tokens: np.ndarray) -> bytes:
    """Ascending tokens: the bytes of their differences, plane by plane, compressed."""
    steps = np.diff(tokens, prepend=_U(0)).astype("<u8")
    return _squeezed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=_U)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _expanded(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class _Cell:
    """Texts of a task until they are dealt out together."""

    def __init__(self):
        self.tokens, self.docs, self.ids, self.known, self.held = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        t, of = shingles(texts)
        self.tokens.append(t)
        self.docs.append((of + sum(map(len, self.ids))).astype(np.uint16))
        self.ids.append(ids.fill_null(0).to_numpy())
        self.known.append(ids.is_valid().to_numpy(zero_copy_only=False))
        self.held += len(t)

    def full(self) -> bool:
        return self.held >= CELL_TOKENS or sum(map(len, self.ids)) >= CELL_DOCS

    def dealt(self, name: str, ranges: int) -> pa.RecordBatch:
        """A row of the cell's sets and of tokens that several of them have; a row for each range of the tokens."""
        t, d = np.concatenate(self.tokens), np.concatenate(self.docs)
        order = np.argsort(t, kind="stable")
        t, d = t[order], d[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        t, d = t[new], d[new]
        sets = np.zeros(sum(map(len, self.ids)), _SETS)
        sets["doc_id"], sets["known"] = np.concatenate(self.ids), np.concatenate(self.known)
        sets["n"] = np.bincount(d, minlength=len(sets))
        if len(t):
            by_doc = t[np.argsort(d, kind="stable")]
            some = sets["n"] > 0
            starts = (np.cumsum(sets["n"]) - sets["n"])[some]
            sets["f1"][some] = np.add.reduceat(mixed(by_doc, 1), starts)
            sets["f2"][some] = np.bitwise_xor.reduceat(mixed(by_doc, 2) * _U(0xC2B2AE3D27D4EB4F), starts)
            for k in range(STARS):
                sets["least"][some, k] = np.minimum.reduceat(mixed(by_doc ^ _U(k), 2 + k), starts)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, int)
        counts = np.diff(np.append(first, len(t)))
        own, docs = t[first], np.where(counts == 1, d[first], _SEVERAL).astype("<u2")
        shared = np.repeat(counts > 1, counts)
        cell = xxhash.xxh3_64_intdigest(name.encode() + sets.tobytes())
        rows = [(cell % ranges, _squeezed(sets), _packed(t[shared]), _squeezed(d[shared].astype("<u2")), b"")]
        edges = np.searchsorted(((own >> _U(32)) * _U(ranges)) >> _U(32), np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[r], edges[r + 1])
            rows.append((r, None, _packed(own[at]), _squeezed(docs[at]), _squeezed(counts[at][docs[at] == _SEVERAL].astype("<u4"))))
        columns = list(zip(*rows))
        columns.insert(1, [cell - (1 << 64) if cell >> 63 else cell] * len(rows))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DEALT)], schema=_DEALT)


def _deal(docs: DataFrame) -> DataFrame:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(64, min(1 << 20, -(-int(size) // RANGE_BYTES)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number, task = _Cell(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20, 2000):
                cell.add(rows.column("doc_id"), rows.column("text"))
                if cell.full():
                    yield cell.dealt(f"{task} {number}", ranges)
                    cell, number = _Cell(), number + 1
        if cell.ids:
            yield cell.dealt(f"{task} {number}", ranges)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(dealt, _DEALT_DDL)


def _counted(table: pa.Table) -> pa.Table:
    """Of a range of tokens, those that two documents or more have, for each cell, with their counts."""
    rows = [tuple(r.values()) for r in table.select(["range", "cell", "sets", "tokens", "docs", "counts"]).to_pylist()]
    out = [r for r in rows if r[2] is not None]
    rows = [r for r in rows if r[2] is None]
    if rows:
        tokens, docs, counts = [_unpacked(r[3]) for r in rows], [_expanded(r[4], "<u2") for r in rows], []
        for d, r in zip(docs, rows):
            c = np.ones(len(d), np.int64)
            c[d == _SEVERAL] = _expanded(r[5], "<u4")
            counts.append(c)
        ends = np.cumsum([0, *map(len, tokens)])
        t, c = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t = t[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        total = np.empty(len(t), np.int64)
        total[order] = np.repeat(np.add.reduceat(c[order], first), np.diff(np.append(first, len(t))))
        for k, r in enumerate(rows):
            df = total[ends[k] : ends[k + 1]]
            back = df > 1
            if back.any():
                out.append((r[0], r[1], None, _packed(tokens[k][back]), _squeezed(docs[k][back]), _squeezed(np.minimum(df[back], 2**32 - 1).astype("<u4"))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, _DEALT)], schema=_DEALT)


_SET_DDL = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, least array<bigint>, alone bigint, tokens array<bigint>, " + ", ".join(f"prefix{k} array<bigint>" for k in range(ORDERS))
_SET_TYPES = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64()] + [pa.list_(pa.int64())] * (1 + ORDERS)


def order_key(tokens: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
    """Sort key of repeated tokens under an order: frequencies to the unit, the power of two, or of four; then a hash."""
    rank = df.astype(_U) if order == 0 else (np.log2(df).astype(_U) // _U(order))
    return (rank << _U(32)) | (mixed(tokens, order) >> _U(32))


def _described(table: pa.Table) -> pa.Table:
    """The sets of a cell; those that may link with their repeated tokens and prefixes."""
    rows = table.to_pylist()
    own = [r for r in rows if r["sets"] is not None]
    if len(own) != 1:
        raise RuntimeError("the texts of a cell changed between runs of its task: read them from a table")
    sets = _expanded(own[0]["sets"], _SETS)
    rows = [r for r in rows if r["sets"] is None]
    t = np.concatenate([np.zeros(0, _U), *(_unpacked(r["tokens"]) for r in rows)])
    d = np.concatenate([np.zeros(0, "<u2"), *(_expanded(r["docs"], "<u2") for r in rows)]).astype(np.int64)
    df = np.concatenate([np.zeros(0, "<u4"), *(_expanded(r["counts"], "<u4") for r in rows)]).astype(np.int64)
    several = d == _SEVERAL
    order = np.argsort(t[several])
    known, known_df = t[several][order], df[several][order]
    shared, of = _unpacked(own[0]["tokens"]), _expanded(own[0]["docs"], "<u2").astype(np.int64)
    t, d = np.concatenate([t[~several], shared]), np.concatenate([d[~several], of])
    df = np.concatenate([df[~several], known_df[np.searchsorted(known, shared)]])
    n = sets["n"]
    alone = n - np.bincount(d, minlength=len(sets))
    most = prefix_length(n)
    live = (n > 0) & (alone < most)
    keep = live[d]
    t, d, df = t[keep], d[keep], df[keep]
    size, room = np.where(live, n - alone, 0), np.where(live, most - alone, 0)
    starts = np.cumsum(size) - size

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(_U, copy=False).view(np.int64)), mask=pa.array(~live))

    columns = [pa.array(sets["doc_id"], mask=~sets["known"]), pa.array(n), *(pa.array(np.ascontiguousarray(sets[f]).view(np.int64)) for f in ("f1", "f2"))]
    columns += [lists(sets["least"][live].reshape(-1), np.where(live, STARS, 0)), pa.array(alone)]
    columns.append(lists(t[np.lexsort((t, d))], size))
    place = np.arange(len(t)) - starts[np.sort(d)]
    for k in range(ORDERS):
        order = np.lexsort((t, order_key(t, df, k), d))
        front = order[place < room[d[order]]]
        columns.append(lists(t[front], np.minimum(room, size)))
    return pa.Table.from_arrays([c.cast(x) for c, x in zip(columns, _SET_TYPES)], names=[c.split()[0] for c in _SET_DDL.split(", ")])


def describe(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, set fingerprint f1 and f2, and of sets that
    may link their least hashes, number of tokens of no other document, other tokens and their prefixes."""
    counted = _deal(docs).groupBy("range").applyInArrow(_counted, _DEALT_DDL)
    return counted.groupBy("cell").applyInArrow(_described, _SET_DDL)


# --- comparisons ---------------------------------------------------------------------------
def reach(n: Column, m: Column) -> Column:
    """The least count of shared tokens, times 100 + SHARE, at which sets of ``n`` and ``m`` link."""
    return SHARE * (n + m)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of documents that link. A document's sets are rows of ``sets``.

    Both joins are on ids of single rows, so a document in many pairs is a skewed key that
    Spark splits, not a group.
    """
    x = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("tokens").alias("y"))
    both = pairs.join(y, "b").join(x, "a")
    return both.where((100 + SHARE) * F.size(F.array_intersect("x", "y")) >= reach(F.col("n"), F.col("m"))).select("a", "b").distinct()


# --- components ----------------------------------------------------------------------------
def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (least node of its component) for every node of ``edges`` (a, b).

    Labels go down to the least neighbour's and then to their label's label until none
    changes; every round is a written table.
    """
    both = scratch.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("comp").alias("near"))
        down = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        new = scratch.written(down.join(up, "low", "left").select("node", F.col("comp").alias("old"), F.least("low", "jump").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").limit(1).count() == 0:
            return labels


def _stars(reps: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with the least document that shares one of its least hashes."""
    least = reps.select("doc_id", F.posexplode("least").alias("k", "h"))
    hubs = least.groupBy("k", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("k", "h", "a")
    return least.join(hubs, ["k", "h"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def candidates(reps: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of different components whose prefixes meet, near enough to their starts, under every order."""
    named = reps.join(comps, F.col("doc_id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    prefixes = named.select(
        "doc_id", "comp", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.col("alone")).alias("repeated"),
        F.posexplode(F.array(*[f"prefix{k}" for k in range(ORDERS)])).alias("order", "prefix"),
    )
    posted = prefixes.select("order", "doc_id", "comp", "n", "repeated", F.posexplode("prefix").alias("place", "token"))
    posted = posted.select("order", "token", "doc_id", "comp", "n", (F.col("repeated") - F.col("place")).alias("left"))
    lists = posted.groupBy("order", "token", "comp").agg(F.count(F.lit(1)).alias("c"))
    lists = lists.groupBy("order", "token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"))
    lists = lists.where("k > 1").select("order", "token", F.col("top.comp").alias("main"))
    mixed_lists = scratch.written(posted.join(lists, ["order", "token"]), "postings")
    x, y = mixed_lists.where("comp <> main").alias("x"), mixed_lists.alias("y")
    near = F.least("x.left", "y.left") * (100 + SHARE) >= reach(F.col("x.n"), F.col("y.n"))
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.comp") < F.col("y.comp"))
    met = x.join(y, (F.col("x.order") == F.col("y.order")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & once & near)
    met = met.select(F.col("x.order").alias("order"), F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).where(f"orders = {ORDERS}").select("a", "b")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Null and wordless texts have no shingle and are their own component. Repeated rows each
    have a row; a null doc_id takes no part in links and has a null component. Rows that share
    a doc_id are one document with several texts. A very long text is a cell of its own.
    Empty in, empty out. Other columns of ``docs`` are not read, whatever their names.
    """
    with Scratch(docs.sparkSession, "ngram-join") as scratch:
        described = scratch.written(describe(docs.select("doc_id", "text")), "described")
        live = described.where("tokens IS NOT NULL AND doc_id IS NOT NULL")
        key = ["n_shingles", "f1", "f2"]
        classes = live.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        # A document's equal rows are one set of it.
        sets = live.join(classes.withColumnRenamed("rep", "doc_id").drop("size"), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
        sets = scratch.written(sets, "sets")
        copies = live.select("doc_id", *key).join(classes.where("size > 1"), key).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
        copies = scratch.written(copies, "copies")
        stars = scratch.written(verify(_stars(sets), sets), "stars")
        comps = components(stars, scratch)
        rest = scratch.written(verify(candidates(sets, comps, scratch), sets), "rest")
        comps = components(copies.unionByName(stars).unionByName(rest), scratch)
        named = described.select("doc_id", "n_shingles").join(comps, F.col("doc_id") == F.col("node"), "left")
        return written(named.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")), "components")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least id stays.

    Rows with a null id stay. A document that has several texts under its id keeps each; of
    its rows with equal texts one stays, the first by the other columns.
    """
    comps = near_duplicate_components(docs).where("doc_id IS NOT NULL")
    stays = comps.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, F.col("doc_id") == F.col("__id"), "left_semi")
    text = [F.xxhash64("text"), F.crc32("text")]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    turn = F.row_number().over(Window.partitionBy("doc_id", *text).orderBy(F.xxhash64(*others) if others else F.lit(0)))
    kept = kept.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
    return kept.unionByName(docs.where("doc_id IS NULL"))

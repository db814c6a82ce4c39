"""Mixing sources to target weights by systematic sampling.

Within a source, every document is expected ``target / source_size`` times. Documents are
put in a fixed order, the expected copies are summed along it from one random offset, and a
document is emitted once for each integer that the running sum crosses at it. The order goes
by size, so the words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, word_count

#: Weights of the sources, by code point of the name, null last; they repeat.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words, and of a source at most, as a multiple of its own.
SHARE, CAP = 1.5, 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size`` (a row a source) to ``source, source_size, target``.

    A target is the source's weight times a level common to all, or its cap if that is less.
    The level at which all targets sum to the share wanted is where giving away what is over
    the caps ends. It is found by one pass over the sources in order of cap by weight.
    A share above the cap gives every source its cap; a source without words gets 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("most").over(so_far), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)),
        "wanted": F.sum("source_size").over(whole) * F.lit(float(share)),
    })
    # With all sources before this one at their caps, the level for the rest.
    rows = rows.withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open"))
    at = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("found", F.min(F.when(at, F.struct("capped", "level"))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("found") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that only the source and the seed decide."""
    digits = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    value = F.lit(0)
    for i in range(6):
        value = value * 16 + F.instr(F.lit("0123456789abcdef"), F.substring(digits, i + 1, 1)) - 1
    return value / F.lit(16.0**6)


def mix_counts(docs: DataFrame, seed: int = 29) -> DataFrame:
    """``docs`` with new columns size, source_size, target, copies (int) and taken.

    Equal rows are interchangeable and may get different copies; null text has size 0, null
    source is a source of its own; old columns of the new names give way; empty in, empty out.
    Documents are ordered by octave and leading bits of their size, then 256 ways by a hash,
    so that no task ranks more than a small part of a source.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = word_count(F.col("text"))
    noise = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    rows = docs.select(row, F.col("source").cast("string").alias("source"), size.alias("size"), noise.alias("noise"))
    lead = F.substring(F.bin("size"), 1, 4)
    rows = rows.withColumns({"octave": F.length(F.bin("size")), "lead": lead, "sub": F.substring("noise", 1, 2)})
    strata = rows.groupBy("source", "octave", "lead", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    # A row a source, and for each stratum the documents before it in its source.
    sizes = strata.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("octave", "lead", "sub").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words")
    targets = source_targets(sizes).withColumn("offset", _offset(F.col("source"), seed))
    strata, s, t = strata.alias("s"), F.col("s.source"), F.col("t.source")
    plan = strata.join(targets.alias("t"), s.eqNullSafe(t)).select("s.*", "t.source_size", "t.target", "t.offset").alias("p")
    inner = Window.partitionBy("source", "octave", "lead", "sub").orderBy("size", "noise")
    ranked = rows.withColumn("rank", F.row_number().over(inner)).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("p.source"))
    for c in ("octave", "lead", "sub"):
        same = same & (F.col(f"r.{c}") == F.col(f"p.{c}"))
    both = ranked.join(plan, same)
    k, rate = F.col("p.before") + F.col("r.rank"), F.when(F.col("p.source_size") > 0, F.col("p.target") / F.col("p.source_size")).otherwise(0.0)
    crossed = F.floor(k * rate + F.col("p.offset")) - F.floor((k - 1) * rate + F.col("p.offset"))
    copies = F.least(crossed, F.lit(CAP)).cast("int")
    out = both.select("r.row.*", *[x.alias(f"__{n}") for n, x in (
        ("size", F.col("r.size")), ("source_size", F.col("p.source_size")), ("target", F.col("p.target")), ("copies", copies),
        ("taken", copies * F.col("r.size")))])
    new = ["size", "source_size", "target", "copies", "taken"]
    return add_columns(out, **{n: F.col(f"__{n}") for n in new}).drop(*[f"__{n}" for n in new])


def mixed(docs: DataFrame, seed: int = 29) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their columns."""
    counted = mix_counts(docs, seed)
    return counted.filter("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Engine: scan, redact, report and restore over DataFrames.

A scan or redaction is a projection: no shuffle, any partitioning, any number of text
columns, batch or streaming. Cross-row results (statistics, compliance) aggregate findings.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalized
from ..functions.text import name
from ..operators import detect
from ..operators.catalog import Detector, active
from ..operators.replace import Strategy, last_by_replacement, masked, preview, replaced, restored, stats, vault
from ..operators.taxonomy import classify, resolve_preset, with_taxonomy
from .config import Config

TEXT, FOUND, ROWS = "__text", "__found", "__rows"


@dataclass(frozen=True)
class Engine:
    """What to look for, what passes, and how it is replaced. Made by :func:`engine`."""

    detectors: tuple[Detector, ...]
    strategy: Strategy = Strategy()
    min_confidence: float = 0.7
    only: frozenset[str] | None = None
    exclude: frozenset[str] = frozenset()
    allowlist: tuple[str, ...] = ()
    min_severity: str = ""
    reversible: bool = False
    normalize: bool = False
    fold_homoglyphs: bool = False
    max_input_size: int = 0

    def found_sql(self, text: str) -> str:
        """Array of resolved findings of a text. Detectors whose findings cannot pass do not run."""
        runs = [d for d in self.detectors if detect.could_pass(d, self.min_confidence, self.only, self.exclude)]
        every = detect.all_findings(runs, text)
        return detect.resolved(detect.filtered(every, self.min_confidence, self.only, self.exclude, self.allowlist, self.min_severity))

    def masked_sql(self, text: str) -> str:
        """The masked text of a text."""
        return masked(text, replaced(self.found_sql(text), self.strategy))

    def prepared(self, text: Column) -> Column:
        """Normalised if asked for; a text beyond the size limit is an error, before and after."""
        def guarded(c: Column) -> Column:
            if not self.max_input_size:
                return c
            message = F.lit(f"a text is longer than {self.max_input_size} characters")
            return F.when(F.length(c) > self.max_input_size, F.raise_error(message)).otherwise(c)

        text = guarded(text)
        return guarded(normalized(text, self.fold_homoglyphs)) if self.normalize else text

    def masked_column(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the column masked."""
        df = df.withColumn(TEXT, self.prepared(F.col(column)))
        return df.withColumn(column, F.expr(self.masked_sql(TEXT))).drop(TEXT)


def engine(
    config: Config | None = None,
    *,
    strategy: str | Strategy | None = None,
    preset: str | None = None,
    min_confidence: float | None = None,
    only=None,
    exclude=(),
    allowlist=None,
    min_severity: str | None = None,
    reversible: bool | None = None,
    normalize: bool | None = None,
    fold_homoglyphs: bool | None = None,
    max_input_size: int | None = None,
) -> Engine:
    """Explicit options beat the preset, the preset beats the configuration."""
    c = config or Config()
    if not isinstance(strategy, Strategy):
        strategy = Strategy(strategy or c.strategy, template=c.placeholder_template, key=c.pseudonym_key)
    least = c.min_confidence
    if preset_name := (c.preset if preset is None else preset):
        types, confidence = resolve_preset(preset_name)
        only = types if only is None else only
        least = least if confidence is None else confidence
    return Engine(
        detectors=tuple(active(c.disabled_detectors, c.enabled_detectors, c.custom_patterns)),
        strategy=strategy,
        min_confidence=least if min_confidence is None else min_confidence,
        only=None if only is None else frozenset(only),
        exclude=frozenset(exclude or ()),
        allowlist=tuple(c.allowlist if allowlist is None else allowlist),
        min_severity=c.min_severity if min_severity is None else min_severity,
        reversible=c.reversible if reversible is None else reversible,
        normalize=c.normalize if normalize is None else normalize,
        fold_homoglyphs=c.fold_homoglyphs if fold_homoglyphs is None else fold_homoglyphs,
        max_input_size=c.max_input_size if max_input_size is None else max_input_size,
    )


def with_findings(df: DataFrame, text: str = "text", eng: Engine | None = None, into: str = "findings") -> DataFrame:
    """``df`` with an array of findings (type, start, end, value, confidence, detector)."""
    eng, f = eng or engine(), name("f")
    df = df.withColumn(TEXT, eng.prepared(F.col(text))).withColumn(FOUND, F.expr(eng.found_sql(TEXT)))
    fields = ", ".join(f"'{k}', {f}.{k}" for k in ("type", "start", "end", "value", "confidence", "detector"))
    return df.withColumn(into, F.expr(f"transform({FOUND}, {f} -> named_struct({fields}))")).drop(TEXT, FOUND)


def scan(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), eng: Engine | None = None) -> DataFrame:
    """A row a finding: keys, type, start, end, value, confidence, detector."""
    rows = with_findings(df.select(*keys, text), text, eng, "__f")
    # Not explode: for it Spark would infer a filter that computes all findings once more.
    return rows.select(*keys, F.explode_outer("__f").alias("f")).where("f IS NOT NULL").select(*keys, "f.*")


def redact(df: DataFrame, text: str = "text", eng: Engine | None = None) -> DataFrame:
    """``df`` without the text but with original_length, masked_text, findings, stats, placeholders and vault.

    Lengths and offsets are those of the normalised text if there is one. The vault is empty
    unless the engine is reversible. Null stays null, with no findings.
    """
    eng, f = eng or engine(), name("f")
    df = df.withColumn(TEXT, eng.prepared(F.col(text))).withColumn(FOUND, F.expr(eng.found_sql(TEXT)))
    df = df.withColumn(ROWS, F.expr(replaced(FOUND, eng.strategy)))
    fields = ", ".join(f"'{x}', {f}.{x}" for x in ("type", "start", "end", "value", "confidence", "detector"))
    df = df.drop(text).withColumns({
        "original_length": F.length(TEXT),
        "masked_text": F.expr(masked(TEXT, ROWS)),
        "findings": F.expr(f"transform({FOUND}, {f} -> named_struct({fields}))"),
        "stats": F.expr(stats(ROWS)),
        "placeholders": F.expr(last_by_replacement(ROWS, "type")),
        "vault": F.expr(vault(ROWS) if eng.reversible else "cast(map() as map<string,string>)"),
    })
    return df.drop(TEXT, FOUND, ROWS)


def restore(df: DataFrame, masked_text: str = "masked_text", vault_column: str = "vault", into: str = "text") -> DataFrame:
    """``df`` with the original text put back from each row's vault."""
    return df.withColumn(into, F.expr(restored(masked_text, vault_column)))


def vault_rows(redacted: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Vaults as rows: keys, replacement, original; for a table of their own."""
    return redacted.select(*keys, F.explode("vault").alias("replacement", "original"))


def audit(findings: DataFrame, salt: bytes | None = None) -> DataFrame:
    """Findings without their values: with category, severity, a salted hash and a preview, and the salt.

    The salt is drawn once, on the driver, unless given.
    """
    salt = os.urandom(16) if salt is None else salt
    rows = with_taxonomy(findings)
    salted = F.concat(F.unhex(F.lit(salt.hex())), F.col("value").cast("binary"))
    keep = [c for c in findings.columns if c not in ("value", "confidence")]
    return rows.select(
        *keep, F.round("confidence", 3).alias("confidence"), "category", "severity",
        F.substring(F.sha2(salted, 256), 1, 32).alias("value_sha256"), F.expr(preview("value")).alias("preview"), F.lit(salt.hex()).alias("salt"),
    )


def stats_by_type(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings and distinct values by type and keys."""
    return findings.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def compliance(findings: DataFrame, *keys: str) -> DataFrame:
    """Regulations touched, with their types."""
    return classify(findings, *keys)


def evaluate(found: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 of found types against expected ones, by type and in all (type null).

    Both have (key, type); what counts is whether a type is in a text at all.
    """
    got = found.select(key, "type").distinct().withColumn("got", F.lit(1))
    want = expected.select(key, "type").distinct().withColumn("want", F.lit(1))
    both = got.join(want, [key, "type"], "full").select("type", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("want", F.lit(0)).alias("want"))
    sums = both.rollup("type").agg(
        F.sum(F.col("got") * F.col("want")).alias("tp"), F.sum(F.col("got") * (1 - F.col("want"))).alias("fp"), F.sum((1 - F.col("got")) * F.col("want")).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    sums = sums.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return sums.withColumn("f1", f1)


def recall_by_category(found: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """True positives, misses and recall of expected types, by category: category, tp, fn, recall.

    Both have (key, type); what counts is whether a type is in a text at all. Categories that
    nothing is expected of have no row.
    """
    got = found.select(key, "type").distinct().withColumn("got", F.lit(1))
    want = with_taxonomy(expected.select(key, "type").distinct()).select(key, "type", "category")
    hit = F.coalesce("got", F.lit(0))
    sums = want.join(got, [key, "type"], "left").groupBy("category").agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fn"))
    return sums.withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn")))

"""Command line: python -m maskwright {redact,scan,stats,restore,check,batch,detectors,types} ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import taxonomy
from .operators.catalog import active, catalog
from .operators.replace import STRATEGIES, preview
from .plans import engine as plans
from .plans.config import load_config
from .sources import readers
from .sources.formats import FORMATS, redact_format


def _types(value: str) -> list[str]:
    return [t.strip().upper() for t in value.split(",") if t.strip()]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *outputs: str, many: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input", nargs="+" if many else None, help="file, folder or pattern; - is standard input")
        for o in outputs:
            c.add_argument(o)
        c.add_argument("--config")
        c.add_argument("--preset", choices=sorted(taxonomy.PRESETS))
        c.add_argument("--min-confidence", type=float)
        c.add_argument("--min-severity", choices=["low", "medium", "high", "critical"])
        c.add_argument("--only", type=_types, help="these types, by commas")
        c.add_argument("--exclude", type=_types, default=(), help="not these types, by commas")
        c.add_argument("--normalize", action="store_true", default=None, help="NFKC first")
        c.add_argument("--fold-homoglyphs", action="store_true", default=None, help="fold look-alikes in mixed words, with --normalize")
        c.add_argument("--max-input-size", type=int, help="fail on a text of more characters; 0: no limit")
        c.add_argument("--lines", action="store_true", help="a text a line instead of a text a file")
        return c

    c = add("redact", "output")
    c.add_argument("--strategy", choices=STRATEGIES)
    c.add_argument("--format", choices=["text", *FORMATS], default="text")
    c.add_argument("--reversible", action="store_true", default=None, help="keep each text's vault")
    c.add_argument("--vault", help="folder for the vault table; makes the masking reversible")
    c.add_argument("--report", help="folder for the audit report")
    c.add_argument("--json", action="store_true", help="JSON lines with findings and vaults instead of Parquet; output - prints them")
    c.add_argument("--stream", action="store_true", help="mask by blocks of lines, in bounded memory")
    add("scan").add_argument("--json", action="store_true", help="JSON lines, which is the default")
    add("stats").add_argument("--json", action="store_true", help="JSON lines, which is the default")
    add("check", many=True)
    c = add("batch", many=True)
    c.add_argument("--out-dir", required=True)
    c.add_argument("--form", choices=["text", "parquet"], default="text")
    c = sub.add_parser("restore")
    c.add_argument("input", help="folder that redact wrote")
    c.add_argument("vault")
    c.add_argument("output")
    for name in ("detectors", "types"):
        sub.add_parser(name).add_argument("--config")
    return p


def _engine(a: argparse.Namespace, **more) -> plans.Engine:
    """The engine of the options. A type that no detector gives is an error."""
    config = load_config(a.config)
    known = {d.type for d in catalog(config.custom_patterns)}
    if unknown := sorted({*(a.only or ()), *a.exclude} - known):
        raise ValueError(f"unknown types: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    names = ("preset", "min_confidence", "min_severity", "only", "exclude", "normalize", "fold_homoglyphs", "max_input_size")
    return plans.engine(config, **{n: getattr(a, n) for n in names}, **more)


def _show(df: DataFrame) -> None:
    """Rows as JSON lines, streamed to the driver a partition at a time."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def _texts(spark: SparkSession, path, lines: bool) -> DataFrame:
    """file, text of the input; of standard input if it is -."""
    if path in ("-", ["-"]):
        read = sys.stdin.read()
        return spark.createDataFrame([("-", t) for t in (read.splitlines() if lines else [read])], "file string, text string")
    return (readers.read_lines if lines else readers.read_texts)(spark, path)


def _redact(spark: SparkSession, a: argparse.Namespace) -> int:
    eng = _engine(a, strategy=a.strategy, reversible=a.reversible or bool(a.vault) or None)
    if a.stream:
        _show(readers.redact_files(spark, a.input, a.output, eng))
        return 0
    texts = _texts(spark, a.input, a.lines)
    if a.format != "text":
        redact_format(texts, a.format, eng=eng).write.parquet(a.output)
        return 0
    done = plans.redact(texts, eng=eng)
    rows = done.select("file", "masked_text", *(["vault"] if eng.reversible else []), *(["findings", "stats", "placeholders"] if a.json else []))
    if a.json:
        rows = rows.withColumn("findings", F.expr("transform(findings, f -> named_struct('type', f.type, 'start', f.start, 'end', f.end, 'confidence', f.confidence, 'detector', f.detector))"))
    if a.output == "-":
        _show(rows)
    elif a.json:
        rows.write.json(a.output)
    else:
        rows.write.parquet(a.output)
    if a.vault:
        readers.write_vault(done, a.vault, ("file",))
    if a.report:
        plans.audit(plans.scan(texts, keys=("file",), eng=eng)).write.json(a.report)
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """0: done; 1: ``check`` found something, or ``batch`` met files that it could not read."""
    if a.command == "detectors":
        config = load_config(a.config)
        on = {d.name for d in active(config.disabled_detectors, config.enabled_detectors, config.custom_patterns)}
        for d in catalog(config.custom_patterns):
            print(d.name, d.type, "on" if d.name in on else "off", sep="\t")
        return 0
    if a.command == "types":
        own = [d.type for d in catalog(load_config(a.config).custom_patterns)]
        for t in dict.fromkeys([*taxonomy.CATEGORY_OF, *own]):
            print(t, taxonomy.category_of(t), taxonomy.severity_of(t), ",".join(taxonomy.regulations_for(t)), sep="\t")
        return 0
    if a.command == "restore":
        vault = spark.read.parquet(a.vault)
        readers.restore_from(spark.read.parquet(a.input), vault, "file").select("file", "text").write.parquet(a.output)
        return 0
    if a.command == "redact":
        return _redact(spark, a)
    eng = _engine(a)
    if a.command == "batch":
        counts = readers.redact_files(spark, a.input, a.out_dir, eng, form=a.form)
        _show(counts)
        return int(counts.where("findings < 0").limit(1).count() > 0)
    found = plans.scan(_texts(spark, a.input, a.lines), keys=("file",), eng=eng)
    if a.command == "scan":
        _show(taxonomy.with_taxonomy(found).withColumn("preview", F.expr(preview("value"))).drop("value", "severity_rank"))
    elif a.command == "stats":
        _show(found.groupBy("type").agg(F.count(F.lit(1)).alias("n")))
    return int(a.command == "check" and found.limit(1).count() > 0)


def main(argv: list[str] | None = None) -> int:
    """Exit code: that of :func:`run`; 2 for wrong options or configuration."""
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    try:
        return run(spark, a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

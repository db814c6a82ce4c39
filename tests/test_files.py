"""Files, blocks of lines, streams, the command line and plugins."""

import gzip
import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright.operators import catalog
from maskwright.plans import engine as E
from maskwright.sources import readers
from maskwright.streaming import stream

KEY = "-----BEGIN PRIVATE " + "KEY-----\nMIIBVAIBADANBg\nabcdEFGH\n-----END PRIVATE " + "KEY-----\n"


def test_blocks(spark, tmp_path):
    """A finding over lines is found within a block, and torn where a block ends."""
    (tmp_path / "key.txt").write_text("head\n\n" + KEY + "tail")
    found = lambda size: E.redact(readers.read_blocks(spark, str(tmp_path), size), eng=E.engine()).collect()
    assert [r["masked_text"] for r in found(2000)] == ["head\n\n[PRIVATE_KEY_1]\ntail"]
    torn = sorted(found(4), key=lambda r: r["block"])
    assert [r["block"] for r in torn] == [0, 1] and "MIIBVAIBADANBg" in torn[0]["masked_text"]
    with pytest.raises(ValueError):
        readers.read_blocks(spark, str(tmp_path), 0)


def test_blocks_of_lines_in_order(spark, tmp_path):
    lines = [f"line {i}" for i in range(25_001)]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    rows = readers.read_blocks(spark, str(tmp_path), 1000).orderBy("split", "block").collect()
    assert "\n".join(r["text"] for r in rows).split("\n") == lines
    assert {len(r["text"].split("\n")) for r in rows} <= {1000, 1}


def test_batch(spark, tmp_path):
    """Unreadable and missing files have -1 and do not stop the others; an empty file has 0."""
    (tmp_path / "a+b c.txt").write_text("one a@b.com\ntwo c@d.org\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.gz").write_bytes(b"this is no gzip")
    with gzip.open(tmp_path / "good.gz", "wt") as f:
        f.write("card 4111 1111 1111 1111\n")
    paths = [f"{tmp_path}/*", f"{tmp_path}/none.txt"]
    got = {unquote(r["file"]).rsplit("/", 1)[-1]: r["findings"] for r in readers.redact_files(spark, paths, f"{tmp_path}/out", form="text").collect()}
    assert got == {"a+b c.txt": 2, "empty.txt": 0, "bad.gz": -1, "good.gz": 1, "none.txt": -1}
    text = spark.read.text(f"{tmp_path}/out").where(F.col("file").contains("b c")).collect()
    assert [r["value"] for r in text] == ["one [EMAIL_1]", "two [EMAIL_2]"]
    assert readers.redact_files(spark, [f"{tmp_path}/none.txt"], f"{tmp_path}/out2").collect()[0]["findings"] == -1


def test_stream(spark, tmp_path):
    """Blocks on a stream: files of a key each, masked as a whole."""
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text(KEY)
    rows = stream.redact_stream(stream.read_blocks(spark, f"{tmp_path}/in"))
    q = stream.write_masked(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["[PRIVATE_KEY_1]"] * 2


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a@b.com c@d.org"), ("2024-01-01 00:06:00", "x@y.com"), ("2024-01-01 00:06:00", None)]
    spark.createDataFrame(rows, "ts string, text string").write.json(f"{tmp_path}/in")
    live = spark.readStream.schema("ts timestamp, text string").json(f"{tmp_path}/in")
    q = stream.windowed_counts(live, "ts").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["window"]["start"].minute, r["type"], r["n"]) for r in spark.table("win").orderBy("window").collect()] == [(0, "EMAIL", 2), (5, "EMAIL", 1)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "in.txt").write_text("mail a@b.com, карта 4111 1111 1111 1111\n")
    (tmp_path / "clean.txt").write_text("nothing here\n")
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("redact", at("in.txt"), at("out"), "--vault", at("vault"), "--report", at("report")) == 0
    assert spark.read.parquet(at("out")).first()["masked_text"] == "mail [EMAIL_1], карта [CREDIT_CARD_1]\n"
    assert {r["type"] for r in spark.read.json(at("report")).collect()} == {"EMAIL", "CREDIT_CARD"}
    assert run("restore", at("out"), at("vault"), at("back")) == 0
    assert spark.read.parquet(at("back")).first()["text"] == (tmp_path / "in.txt").read_text()
    capsys.readouterr()
    assert run("redact", at("in.txt"), "-", "--json", "--reversible", "--only", "email") == 0
    row = json.loads(capsys.readouterr().out)
    assert row["masked_text"].startswith("mail [EMAIL_1], карта 4111") and row["vault"] == {"[EMAIL_1]": "a@b.com"}
    assert run("scan", at("in.txt"), "--exclude", "email") == 0
    shown = capsys.readouterr().out
    assert json.loads(shown)["category"] == "financial" and "4111 1111" not in shown
    assert run("check", at("in.txt"), at("clean.txt")) == 1 and run("check", at("clean.txt")) == 0
    assert run("check", at("in.txt"), "--min-severity", "critical", "--only", "email") == 0
    assert run("scan", at("in.txt"), "--only", "nonsense") == 2 and "unknown types: NONSENSE" in capsys.readouterr().err
    assert run("batch", at("in.txt"), at("gone.txt"), "--out-dir", at("many")) == 1
    assert sorted(json.loads(x)["findings"] for x in capsys.readouterr().out.splitlines()) == [-1, 2]
    assert run("stats", at("in.txt"), "--config", at("none.json")) == 2
    assert run("types") == 0 and "EMAIL\tcontact" in capsys.readouterr().out
    assert run("detectors") == 0 and "high_entropy\tSECRET\toff" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO("write a@b.com"))
    assert run("redact", "-", "-") == 0 and json.loads(capsys.readouterr().out)["masked_text"] == "write [EMAIL_1]"


def test_options_reach_the_engine(spark):
    masked = lambda text, **o: E.redact(spark.createDataFrame([(text,)], "text string"), eng=E.engine(**o)).first()["masked_text"]
    assert masked("ａ＠ｂ．ｃｏｍ", normalize=True) == "[EMAIL_1]"
    with pytest.raises(Exception, match="longer than 3"):
        masked("four", max_input_size=3)


def test_plugins(monkeypatch):
    """Rows and detectors of plugins join the catalog; broken plugins and rows are left out."""

    class Point:
        def __init__(self, name, rows):
            self.name, self.rows = name, rows

        def load(self):
            return self.rows

    good = Point("good", lambda: [{"name": "badge", "pattern": r"\bB-\d{4}\b"}, catalog.CATALOG[0], {"name": "no pattern"}, 7])
    bad = Point("bad", lambda: 1 / 0)
    monkeypatch.setattr(catalog, "entry_points", lambda group: [bad, good] if group == catalog.PLUGIN_GROUP else [])
    with pytest.warns(UserWarning, match="plugin"):
        found = catalog.plugins()
    assert [d.name for d in found] == ["badge", catalog.CATALOG[0].name]
    with pytest.warns(UserWarning):
        assert "badge" in {d.name for d in catalog.active()} and "badge" not in {d.name for d in catalog.active(disabled=("BADGE",))}

"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, report, quote, other). A cascade of
small transducers rewrites the symbols: negation and reported speech turn insults and threats
after them into weaker ones, a target in the clause strengthens them. The cascade is composed
into one deterministic transducer. Matched clauses are scored, not isolated words; a document
gets the noisy-or of its matches.

Insult terms and the weights of all rewritten symbols are estimated from labelled documents.
A term may be a word or the start of a word, so that inflected forms share their evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used for learning, those with the least hash of their id.
MAX_LABELLED = 40_000
#: Lengths of word starts that may become terms, besides whole words.
STARTS = (4, 5, 6, 7, 8)
#: Evidence (log-likelihood ratio) that a term needs: a million chance terms give about none.
LEAST_EVIDENCE = 18.0
#: Share of a term's contexts that are in toxic documents, at least. Below the second figure a
#: term is a hint: HINT_CHANCE is too little for one match, but not for two.
LEAST_SHARE, PURE_SHARE, HINT_CHANCE = 0.8, 0.97, 0.4

#: Word classes of the grammar: fixed word lists in four languages.
INSULTS = (
    "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown fool imbecile cretin vermin "
    "dummkopf trottel abschaum versager widerlich crétin imbécile ordure minable débile estúpido imbécil escoria basura patético"
).split()
THREATS = "kill hurt destroy crush burn beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself he she they them people du dich dein ihr euch tu toi vous ils elles tú ti usted ustedes ellos".split()
NEGATIONS = "not never no without isn aren nicht kein keine nie pas jamais sans aucun nunca jamás sin ningún".split()
REPORTS = "said says wrote writes called calls quoted reported claims sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()
QUOTES = '"“”«»„'

#: Symbols that count as a match, with the chance of toxicity assumed before any label is seen.
PRIORS = {
    "insult": 0.85, "insult_targeted": 0.95, "insult_negated": 0.5, "insult_reported": 0.55,
    "threat_targeted": 0.6, "threat_negated": 0.2, "threat_reported": 0.2, "threat": 0.1,
}


# --- transducers --------------------------------------------------------------------------
@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, output)``; what has no arc stays and passes."""

    arcs: dict = field(default_factory=dict)
    start: int = 0

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


class Cascade:
    """Composition of transducers, its joint states made as they are met."""

    def __init__(self, *parts: Transducer):
        self.parts, self.memo = parts, {}

    def run(self, symbols: list[str]) -> list[str]:
        state, out = tuple(p.start for p in self.parts), []
        for s in symbols:
            got = self.memo.get((state, s))
            if got is None:
                nexts, o = [], s
                for p, q in zip(self.parts, state):
                    q, o = p.step(q, o)
                    nexts.append(q)
                got = self.memo[state, s] = (tuple(nexts), o)
            state, o = got
            out.append(o)
        return out


def negation(reach: int = 3) -> Transducer:
    """After a negation, ``reach`` words are under it."""
    arcs = {}
    symbols = ("other", "insult", "threat", "target", "report", "quote")
    for left in range(reach + 1):
        arcs[left, "negation"] = (reach, "negation")
        for s in symbols:
            arcs[left, s] = (max(0, left - 1), f"{s}_negated" if left and s in ("insult", "threat") else s)
    return Transducer(arcs)


def reported() -> Transducer:
    """A quotation after a word of saying, up to the closing quote."""
    arcs = {(0, "report"): (1, "report"), (1, "quote"): (2, "quote"), (2, "quote"): (0, "quote")}
    for s in ("insult", "threat"):
        arcs[2, s] = (2, f"{s}_reported")
        arcs[2, f"{s}_negated"] = (2, f"{s}_reported")
    return Transducer(arcs)


def targeted() -> Transducer:
    """A target before an insult or threat, anywhere in the clause."""
    arcs = {(0, "target"): (1, "target")}
    for s in ("insult", "threat"):
        arcs[1, s] = (1, f"{s}_targeted")
    return Transducer(arcs)


class Grammar:
    """Finds the terms of a text and reads the clauses around them through the cascade."""

    def __init__(self, terms: dict[str, float]):
        """``terms``: a word followed by ``$``, or a word's start, with the chance of toxicity."""
        import ahocorasick

        self.terms, self.lengths = terms, sorted({len(t) for t in terms if t[-1] != "$"}, reverse=True)
        self.classes = {w: c for c, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in ws}
        self.classes |= dict.fromkeys(QUOTES, "quote")
        self.find = ahocorasick.Automaton()
        for t in {x.rstrip("$") for x in terms} | set(THREATS):
            self.find.add_word(t, len(t))
        self.find.make_automaton()
        self.edge = re.compile(r"[.!?;:\n]").search
        self.word = re.compile(rf"[^\W\d_]+|[{QUOTES}]").finditer
        self.cascade = Cascade(negation(), reported(), targeted())

    def term(self, word: str) -> str | None:
        if word + "$" in self.terms:
            return word + "$"
        return next((word[:n] for n in self.lengths if word[:n] in self.terms), None)

    def matches(self, text: str | None) -> list[tuple[int, int, str, str | None]]:
        """(start, stop, symbol, term) of each match, in the lower-cased text."""
        text, out, read = (text or "").lower(), [], 0
        for last, n in self.find.iter(text):
            at = last - n + 1
            if at < read or at and text[at - 1].isalpha():
                continue
            # The clause: from the last edge (or what was read) to the next.
            a = max(read, *(text.rfind(c, read, at) + 1 for c in ".!?;:\n"))
            stop = self.edge(text, at)
            read = b = stop.start() if stop else len(text)
            places, symbols, terms = [], [], []
            for m in self.word(text, a, b):
                w = m.group()
                t = self.term(w)
                places.append(m.span())
                terms.append(t)
                symbols.append("insult" if t else self.classes.get(w, "other"))
            for (x, y), s, t in zip(places, self.cascade.run(symbols), terms):
                if s in PRIORS:
                    out.append((x, y, s, t))
        return out


@dataclass(frozen=True)
class Model:
    """``terms`` and ``factors`` (by symbol) multiply to the chance of a match; ``base`` is that of no match."""

    terms: dict
    factors: dict
    base: float

    def chance(self, symbol: str, term: str | None) -> float:
        return min(0.995, (self.terms[term] if term else 1.0) * self.factors[symbol])

    def score(self, matches: list) -> float:
        rest = 1 - self.base
        for _, _, symbol, term in matches:
            rest *= 1 - self.chance(symbol, term)
        return 1 - rest


def held_out() -> F.Column:
    """True for the fifth of ids that is kept from learning; a null id hashes as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms that set toxic documents apart, each with its smoothed chance.

    ``counts`` has a term's contexts in toxic and in clean documents; toxic and clean are
    those of all words.

    Pure terms come first, then hints. Of terms that say the same, the one with most evidence
    stays, then the longest; what a chosen start covers is left out. Seed words stay unless the labels speak against them.
    """
    rate = toxic / max(1, toxic + clean)
    scored = []
    for t, (p, n) in counts.items():
        share = p / max(1, p + n)
        if p >= 3 and share >= LEAST_SHARE and 0 < rate < 1:
            ratio = p * math.log(share / rate) + (n * math.log((1 - share) / (1 - rate)) if n else 0)
            if ratio >= LEAST_EVIDENCE:
                scored.append((share < PURE_SHARE, -ratio, -len(t), t))
    out: dict[str, float] = {}
    for hint, _, _, t in sorted(scored):
        word = t.rstrip("$")
        if not any(word[:k] in out for k in range(1, len(word) + 1)):
            p, n = counts[t]
            out[t] = HINT_CHANCE if hint else (p + 0.5) / (p + n + 1)
    for word in INSULTS:
        p, n = counts.get(word + "$", (0, 0))
        chance = (p + 4 * 0.85) / (p + n + 4)
        if chance > 0.5 and not any(word[:k] in out for k in range(1, len(word) + 1)):
            out.setdefault(word + "$", chance)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents that are not held out.

    Rows without id or label and ids with two labels are left out. Without labels only the
    seed words and assumed weights remain.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").where(~held_out())
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_labelled).select("doc_id", "toxic")
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # A word counts once for each word before it, so that copies of a text add nothing.
    spelled = some.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    follows = F.transform("w", lambda x, i: F.concat(F.when(i > 0, F.get("w", F.greatest(i - 1, F.lit(0)))).otherwise(""), F.lit(" "), x))
    pairs = spelled.select("toxic", F.explode(F.array_distinct(follows)).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.max("toxic").alias("p"), F.max(1 - F.col("toxic")).alias("n"))
    pairs = pairs.withColumn("word", F.substring_index("pair", " ", -1))
    words = pairs.groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    starts = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STARTS]
    terms = words.select("p", "n", F.explode(F.array(F.concat("word", F.lit("$")), *starts)).alias("term"))
    terms = terms.where("term IS NOT NULL").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # What comes to the driver: seed words, all words' sums, and terms that are nearly pure and frequent enough.
    pure = (F.col("p") >= 3) & (F.col("p") >= LEAST_SHARE * (F.col("p") + F.col("n")))
    terms = terms.where(pure | F.col("term").isin([w + "$" for w in INSULTS])).unionByName(
        words.agg(F.lit("").alias("term"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    counts = {r["term"]: (r["p"], r["n"]) for r in terms.collect()}
    chosen = choose_terms(counts, *counts.pop(""))

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, counts = Grammar(chosen), {}
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                for s in {m[2] for m in grammar.matches(text)} or {""}:
                    counts[s, label] = counts.get((s, label), 0) + 1
        if counts:
            yield pa.RecordBatch.from_pylist([{"symbol": s, "toxic": t, "n": n} for (s, t), n in counts.items()],
                                             schema=pa.schema([("symbol", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    seen = some.mapInArrow(symbols, "symbol string, toxic int, n bigint").groupBy("symbol", "toxic").agg(F.sum("n").alias("n")).collect()
    n = {(r["symbol"], r["toxic"]): r["n"] for r in seen}
    strength = 8
    factors = {s: (n.get((s, 1), 0) + strength * p) / (n.get((s, 0), 0) + n.get((s, 1), 0) + strength) for s, p in PRIORS.items()}
    missed, none = n.get(("", 1), 0), n.get(("", 0), 0)
    return Model(chosen, factors, min(0.4, (missed + 0.1) / (missed + none + 10)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with held_out, score, predicted and matches (start, stop, symbol).

    Null and empty texts get the score of a text without a match. Old columns of the new
    names give way. Offsets are code points of the lower-cased text.
    """
    new = ("held_out", "score", "predicted", "matches")
    old = [c for c in docs.columns if c.lower() not in new]
    shaped = "array<struct<start:int,stop:int,symbol:string>>"
    schema_in = docs.select(*[F.col(f"`{c}`") for c in old], F.col("text").alias("__text"), held_out().alias("held_out"))
    fields = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("symbol", pa.string())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.terms)
        for batch in batches:
            found = [grammar.matches(t) for t in batch.column("__text").to_pylist()]
            scores = [model.score(m) for m in found]
            keep = [n for n in batch.schema.names if n != "__text"]
            cols = [batch.column(n) for n in keep] + [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([[{"start": a, "stop": b, "symbol": s} for a, b, s, _ in m] for m in found], fields),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "score", "predicted", "matches"])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in schema_in.schema.fields if f.name != "__text"] + list(
        T.StructType.fromDDL(f"score double, predicted int, matches {shaped}").fields))
    return schema_in.mapInArrow(score, schema)

"""Personal data by weak supervision, next to fixed base patterns.

Base spans come from four patterns with checks. Further candidates come from a wider pattern;
labelers (shape, checksum, gazetteer of lead words, context, border) vote for or against each,
expectation-maximisation over all votes of the corpus estimates how reliable every labeler
is for candidates of each kind, and a logistic span classifier a kind is trained on the
estimated labels. What it accepts, and no base span overlaps, is added. All per-row work uses
built-in functions; the driver sees only counts of vote patterns, a fixed number at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import running
from .common import add_columns, let

KINDS = ("email", "ip", "card", "phone")
#: Kinds the method can add, in the order of spans that start alike (after the base kinds).
ADDED = ("iban", "local_phone", "secret", "ssn")

# The base patterns, written so that Java neither recurses nor rescans a long run: a start
# inside a run that failed from its first character fails too, so a match begins at a run's
# first character or where the last match ended, and loops that cannot give back are possessive.
_MAIL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Shapes of further candidates.
CANDIDATE = (
    r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
    r"|(?:sk|pk|rk|gh[opsu]|glpat|xox[abp]|npm|hf)[_-][0-9A-Za-z_-]{16,}+|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
)
#: Words that lead in each kind, and words that speak against all.
LEADS = {
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|cell|fax)\b",
    "secret": r"(?i)\b(?:token|secret|key|apikey|api_key|password|passwd|auth|bearer)\b",
    "ssn": r"(?i)\b(?:ssn|social\s+security)\b",
}
AGAINST = r"(?i)\b(?:version|build|release|isbn|issn|order|invoice|commit|revision|sha1|sha256|md5|checksum|hash|page|fig|table)\b"
WINDOW = 24


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, value), in code points, stop exclusive."""

    def located(gaps: Column, values: Column) -> Column:
        length = lambda i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0))
        total = lambda steps, first, n: F.aggregate(F.slice(steps, first + 1, n), F.lit(0), lambda p, q: p + q)

        def heads(steps: Column) -> Column:
            """What lies before every 128th step, so that no place needs more than the steps since."""
            blocks = F.sequence(F.lit(0), F.shiftright(F.size(steps), 7))
            return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, k: F.array_append(acc, F.get(acc, k) + total(steps, k * 128, F.lit(128))))

        def placed(steps: Column, before: Column) -> Column:
            start = lambda i: F.get(before, F.shiftright(i, 7)) + total(steps, i - i % 128, i % 128 + 1)
            starts = F.transform(values, lambda v, i: F.struct(start(i).alias("start"), v.alias("value")))
            return F.transform(starts, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value")))

        return let(F.transform(values, lambda v, i: length(i)), lambda steps: let(heads(steps), lambda before: placed(steps, before)))

    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    found = lambda values: F.when(F.size(values) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: located(gaps, values)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets_fit(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def base_spans(text: Column) -> Column:
    """Array of (start, stop, kind) of the base kinds, by start, then kind as listed; with ``rank`` of the kind."""
    long_enough = lambda lo, hi: lambda x: F.length(_digits(x["value"])).between(lo, hi)
    tests = {
        "email": (F.contains(text, F.lit("@")), EMAIL, lambda x: F.lit(True)),
        "ip": (F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), IP, lambda x: _octets_fit(x["value"])),
        "card": (F.rlike(text, F.lit(CARD)), CARD, lambda x: long_enough(12, 19)(x) & _luhn(x["value"])),
        "phone": (F.contains(text, F.lit("+")), PHONE, long_enough(9, 15)),
    }
    shaped = "array<struct<start:int,rank:int,kind:string,stop:int>>"

    def own(rank: int, kind: str) -> Column:
        guard, pattern, good = tests[kind]
        named = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
        return F.when(guard, F.transform(F.filter(spans(text, pattern), good), named)).otherwise(F.array().cast(shaped))

    each = [own(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", _digits(value))


def _iban_rest(value: Column) -> Column:
    """The number of an IBAN, its first four characters put last, modulo 97."""
    v = F.regexp_replace(value, " ", "")
    v = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(v, ""), lambda c: c != ""), F.lit(0), step)


#: The labelers, in the order of the votes.
LABELERS = ("shape", "checksum", "gazetteer", "context", "border")


def candidates(text: Column) -> Column:
    """Array of (start, stop, kind, votes): 1 for, -1 against, 0 no say, one for each labeler."""

    def voted(x: Column) -> Column:
        v, start = x["value"], x["start"]
        kind = (
            F.when(F.rlike(v, F.lit("^[0-9A-F]{32,}$")), "secret")
            .when(F.rlike(v, F.lit("^[A-Z]")), "iban")
            .when(F.rlike(v, F.lit("^[0-9]{3}-[0-9]{2}-")), "ssn")
            .when(F.rlike(v, F.lit("^(?:[a-z]+[_-]|[0-9a-f]{32,}$)")), "secret")
            .otherwise("local_phone")
        )
        lead = F.substring(text, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW)))
        after = F.substring(text, x["stop"] + 1, 2)
        cast = lambda c: c.cast("int")
        yes = lambda good, bad=None: F.when(good, 1).when(F.lit(True) if bad is None else bad, -1).otherwise(0)

        def votes(kind: Column) -> Column:
            shape = (
                F.when(kind == "iban", yes(F.rlike(v, F.lit(r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]+|(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?)$"))))
                .when(kind == "secret", yes(F.length(v).isin(32, 40, 48, 56, 64) | F.rlike(v, F.lit("[_-]"))))
                .when(kind == "local_phone", yes(F.rlike(v, F.lit(r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-]))[0-9]{3}(?:\1|-)[0-9]{4}$"))))
                .otherwise(1)
            )
            check = (
                F.when(kind == "iban", yes(_iban_rest(v) == 1))
                .when(kind == "ssn", yes(~F.rlike(v, F.lit("^(?:000|666|9)|-00-|-0000$"))))
                .when(kind == "secret", yes(F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]"))))
                .otherwise(yes(F.rlike(v, F.lit(r"^\(?[2-9]"))))
            )
            gazetteer = F.lit(None).cast("int")
            for k, pattern in LEADS.items():
                gazetteer = F.coalesce(gazetteer, F.when((kind == k) & F.rlike(lead, F.lit(pattern)), 1))
            gazetteer = F.coalesce(gazetteer, F.lit(0))
            context = F.when(F.rlike(lead, F.lit(AGAINST)), -1).when(F.rlike(lead, F.lit(r"[=:]\s*[\"']?$")), 1).otherwise(0)
            border = F.when(F.rlike(lead, F.lit(r"[0-9][.,/-]?$")) | F.rlike(after, F.lit("^[.,/-]?[0-9]")), -1).otherwise(0)
            return F.array(cast(shape), cast(check), cast(gazetteer), cast(context), cast(border))

        return let(kind, lambda k: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), k.alias("kind"), votes(k).alias("votes")))

    shaped = "array<struct<start:int,stop:int,kind:string,votes:array<int>>>"
    guard = F.rlike(text, F.lit("[0-9a-f]{32}|[0-9A-F]{32}|[a-z][_-][0-9A-Za-z_-]{16}|[0-9]{2}-[0-9]{4}|[0-9]{3}[.\\x20-][0-9]{4}|[A-Z]{2}[0-9]{2}"))
    return F.when(guard, F.transform(spans(text, CANDIDATE), voted)).otherwise(F.array().cast(shaped))


def fit_reliabilities(counts: dict[tuple[int, ...], float], steps: int = 50) -> tuple[float, list[list[dict[int, float]]]]:
    """Share of true candidates, and each labeler's chances of each vote for false and true ones.

    Expectation-maximisation with independent labelers given the truth; it starts at the
    majority of votes, and two pseudo-votes say that a labeler is more often right than wrong.
    """
    total = sum(counts.values()) or 1.0
    truth = {v: 1 / (1 + math.exp(-float(sum(v)))) for v in counts}
    prior, chances = 0.5, []
    n = len(LABELERS)
    for _ in range(steps):
        true = sum(c * truth[v] for v, c in counts.items())
        prior = (true + 1) / (total + 2)
        chances = []
        for j in range(n):
            pair = []
            for y in (0, 1):
                got = {v: 0.5 + (v == (1 if y else -1)) for v in (-1, 0, 1)}
                for v, c in counts.items():
                    got[v[j]] += c * (truth[v] if y else 1 - truth[v])
                whole = sum(got.values())
                pair.append({v: x / whole for v, x in got.items()})
            chances.append(pair)
        for v in truth:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chances[j][1][v[j]] / chances[j][0][v[j]]) for j in range(n))
            truth[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, chances


def train_classifier(counts: dict[tuple[int, ...], float], prior: float, chances: list, rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier (bias first, then for and against of each labeler)."""
    weights = [0.0] * (1 + 2 * len(LABELERS))
    feats, goals = {}, {}
    for v in counts:
        feats[v] = [1.0] + [float(x == 1) for x in v] + [float(x == -1) for x in v]
        odds = math.log(prior / (1 - prior)) + sum(math.log(chances[j][1][x] / chances[j][0][x]) for j, x in enumerate(v))
        goals[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    total = sum(counts.values()) or 1.0
    for _ in range(rounds):
        grads = [0.001 * w for w in weights]
        for v, c in counts.items():
            p = 1 / (1 + math.exp(-sum(w * f for w, f in zip(weights, feats[v]))))
            for k, f in enumerate(feats[v]):
                if f:
                    grads[k] += c / total * (p - goals[v])
        weights = [w - rate * g for w, g in zip(weights, grads)]
    return weights


#: What the classifier gives for kinds that no candidate taught: never.
UNTAUGHT = [-1.0] + [0.0] * (2 * len(LABELERS))


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Classifier weights by kind, from the votes on all candidates of ``docs``.

    Each kind has reliabilities of its own, as a checksum says much of an IBAN and little of a
    telephone number. Null and empty texts have no candidates; repeated rows count each.
    """
    seen = docs.select(F.explode(candidates(F.coalesce(F.col("text"), F.lit("")))).alias("c")).groupBy("c.kind", "c.votes")
    counts: dict[str, dict[tuple[int, ...], float]] = {}
    for r in seen.agg(F.count(F.lit(1)).alias("n")).collect():  # 4 * 3 ** 5 rows at most
        counts.setdefault(r["kind"], {})[tuple(r["votes"])] = float(r["n"])
    return {kind: train_classifier(own, *fit_reliabilities(own)) for kind, own in counts.items()}


def _accepted(c: Column, weights: dict[str, list[float]]) -> Column:
    """Whether the classifier of the candidate's kind says yes."""
    n = len(LABELERS)

    def score(w: list[float]) -> Column:
        out = F.lit(w[0])
        for j in range(n):
            vote = F.get(c["votes"], F.lit(j))
            out = out + F.when(vote == 1, w[1 + j]).when(vote == -1, w[1 + n + j]).otherwise(0.0)
        return out > 0

    says = F.lit(False)
    for kind in ADDED:
        says = F.when(c["kind"] == kind, score(weights.get(kind, UNTAUGHT))).otherwise(says)
    return says


def found(docs: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (start, rank, kind, stop), by start, then kind.

    Null text has no span. Old columns of these names give way. A candidate is added if its
    kind's classifier accepts it and no base span overlaps it; both are sorted together, so a
    candidate is held against the furthest end before it and the first base span after it.
    """
    shaped = "array<struct<start:int,rank:int,kind:string,stop:int>>"
    text = F.coalesce(F.col("text"), F.lit(""))
    df = add_columns(docs, base=base_spans(text), __c=F.filter(candidates(text), lambda c: _accepted(c, weights)))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in ADDED]), k).cast("int") + len(KINDS) - 1
    own = lambda c: F.struct(c["start"].alias("start"), rank(c["kind"]).alias("rank"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    df = add_columns(df, __all=F.when(F.size("__c") == 0, F.array().cast(shaped)).otherwise(F.array_sort(F.concat("base", F.transform("__c", own)))))
    ends = F.expr(running(f"transform(__all, s -> if(s.rank < {len(KINDS)}, s.stop, 0))", "greatest"))
    heads = F.expr(running(f"transform(reverse(__all), s -> if(s.rank < {len(KINDS)}, -s.start, -2147483647))", "greatest"))

    def free(both: Column) -> Column:
        """Candidates without an overlap; ``both``: ends so far, and the starts to come, negated, last first."""
        marked = F.transform("__all", lambda s, i: F.struct(s.alias("s"), F.get(both["e"], i).alias("end"), (-F.get(both["h"], F.size("__all") - 1 - i)).alias("next")))
        fits = F.filter(marked, lambda m: (m["s"]["rank"] >= len(KINDS)) & (m["end"] <= m["s"]["start"]) & (m["next"] >= m["s"]["stop"]))
        return F.transform(fits, lambda m: m["s"])

    added = F.when(F.size("__all") == 0, F.array().cast(shaped)).otherwise(let(F.struct(ends.alias("e"), heads.alias("h")), free))
    return add_columns(df, added=added).drop("__c", "__all")


def listed(spans_: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

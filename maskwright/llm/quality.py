"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering grows conjunctions of thresholds on statistics of a text that pick out
the poor documents, prunes each on rows it was not grown on, and repeats on what the rules
so far leave over. The list becomes one ordered Spark conditional expression; statistics and
verdicts are computed by built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, add_columns, let

#: At most so many labelled rows are used for learning, those with the least hash of their id.
MAX_LABELLED = 20_000
#: Statistics that conditions may test, each by name.
FEATURES = ("n_words", "mean_word", "symbol_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included."""

    def of_sorted(s: Column) -> Column:
        twin = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, i: twin(x, i + 1) | ((i > 0) & twin(x, F.greatest(i - 1, F.lit(0)))))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def of_hashes(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, of_hashes))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with new columns: the base counts (long) and the shares that rules may test.

    Null text counts as empty. Old columns of the new names give way.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    n_chars = F.length(t)
    worded = F.filter(F.split(t, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    words = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    lines = let(worded, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    df = add_columns(
        docs,
        __w=words,
        __l=lines,
        word_chars=without(SPACE).cast("long"),
        n_symbols=(n_chars - without("#*$%&|<>")).cast("long"),
        __marks=(n_chars - without("!?")).cast("long"),
        __digits=(n_chars - without("0123456789")).cast("long"),
        __upper=F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
    )
    df = add_columns(
        df,
        n_words=F.col("__w.n").cast("long"),
        n_dup_lines=F.col("__l.dup").cast("long"),
        n_repeat_words=F.col("__w.again").cast("long"),
        __n_lines=F.col("__l.n"),
    )
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    df = add_columns(
        df,
        mean_word=share("word_chars", "n_words"),
        symbol_share=share("n_symbols", "n_words"),
        mark_share=share("__marks", "n_words"),
        upper_share=share("__upper", "word_chars"),
        digit_share=share("__digits", "word_chars"),
        dup_line_share=share("n_dup_lines", "__n_lines"),
        repeat_share=share("n_repeat_words", "n_words"),
    )
    return df.drop("__w", "__l", "__marks", "__digits", "__upper", "__n_lines")


@dataclass(frozen=True)
class Condition:
    """``feature >= value`` if above, else ``feature < value``."""

    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.value) == self.above

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.above else F.col(self.feature) < self.value


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _worth(rule: Rule, rows: list[dict]) -> float:
    got = _covers(rule, rows)
    bad = sum(r["bad"] for r in got)
    return (2 * bad - len(got)) / (len(got) or 1)


def _grow(rows: list[dict], features: tuple[str, ...], most: int = 4) -> Rule:
    """Add the condition with the greatest information gain until none is left that errs."""
    rule: Rule = ()
    while len(rule) < most:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        base, best, gain = math.log2(bad / len(rows)), None, 1e-9
        for f in features:
            ranked = sorted((r[f], r["bad"]) for r in rows)
            below_bad, last = 0, None
            for k, (v, is_bad) in enumerate(ranked):
                if k and v != last:
                    for above, p, n in ((True, bad - below_bad, len(rows) - k), (False, below_bad, k)):
                        if p and (g := p * (math.log2(p / n) - base)) > gain:
                            # Half way between two neighbours, so that new rows fall evenly.
                            best, gain = Condition(f, above, (v + last) / 2), g
                below_bad, last = below_bad + is_bad, v
        if not best:
            break
        rule += (best,)
        rows = _covers(rule, rows)
    return rule


def learn_rules(rows: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 12, min_cover: int = 3, min_precision: float = 0.7) -> list[Rule]:
    """Ordered rules for poor rows; ``rows`` have the features, ``bad`` and ``part`` (0 to 2; 2 prunes)."""
    grow, prune, rules = [r for r in rows if r["part"] != 2], [r for r in rows if r["part"] == 2], []
    while len(rules) < max_rules:
        rule = _grow(grow, features)
        if not rule:
            break
        # Shorten from the end as long as the pruning rows don't speak against it.
        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: _worth(x, prune))
        both = _covers(best, grow + prune)
        if len(both) < min_cover or sum(r["bad"] for r in both) < min_precision * len(both):
            break
        rules.append(best)
        grow = [r for r in grow if not all(c.holds(r) for c in best)]
        prune = [r for r in prune if not all(c.holds(r) for c in best)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from labelled documents: ``labels`` has doc_id and quality (0 or 1).

    Rows without label or id, and ids with two labels, are left out. Of several texts under
    one id the one with the least statistics teaches. Without poor or without
    good rows there are no rules, and every document passes.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    # The bound on rows bounds what is broadcast and what comes to the driver.
    known = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_labelled)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    part = F.pmod(F.shiftright("h", 8), F.lit(3)).cast("int").alias("part")
    rows = statistics(some).select("doc_id", F.struct(*FEATURES, (1 - F.col("quality")).cast("int").alias("bad"), part).alias("r"))
    got = rows.groupBy("doc_id").agg(F.min("r").alias("r")).select("r.*").collect()
    return learn_rules(sorted((r.asDict() for r in got), key=lambda r: [r[f] for f in FEATURES] + [r["bad"], r["part"]]))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept."""
    df = statistics(docs)
    df = add_columns(df, base_failed=(F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return add_columns(df, kept=~F.col("base_failed") & verdict(rules))

"""Detection, filters and overlap resolution: one SQL expression over a text, no shuffle."""

from __future__ import annotations

from ..functions.checks import CHECKS
from ..functions.text import FINDING, let, matches, name, quoted, running
from .catalog import Detector
from .taxonomy import CATEGORY_OF, severity_of, severity_rank

NONE = f"cast(array() as array<{FINDING}>)"


def _confidence(d: Detector, value: str, context: str) -> str:
    if isinstance(d.base, (int, float)):
        base = f"{float(d.base)}D"
    else:
        *cases, other = d.base
        base = "CASE " + " ".join(f"WHEN {c.format(v=value)} THEN {float(x)}D" for c, x in cases) + f" ELSE {float(other)}D END"
    if d.keyword is None:
        return base
    return f"CASE WHEN {context} RLIKE {quoted('(?iU)' + d.keyword)} THEN {float(d.boosted)}D ELSE {base} END"


#: Tests that a whole group of detectors shares: without such a character none of them can match.
NEEDS = {"digit": r"\p{Nd}", "cyrillic": "[А-яЁё]"}


def findings_of(d: Detector, number: int, text: str) -> str:
    """Array of the findings of one detector, before any filter."""
    groups = (1, 2) if d.grouped else (*d.before, d.value) if d.value else d.groups
    x, y, z = name("x"), name("y"), name("z")
    if d.grouped:
        start, value = f"{x}.at + length({x}.g1)", f"{x}.g2"
    elif d.value:
        start, value = " + ".join([f"{x}.at", *(f"length({x}.g{g})" for g in d.before)]), f"{x}.g{d.value}"
    else:
        start, value = f"{x}.at", f"{x}.v"
    caps = "".join(f", 'g{g}', {x}.g{g}" for g in groups)
    rows = f"transform({matches(text, d.pattern, groups, d.flags)}, {x} -> named_struct('s', {start}, 'v', {value}{caps}))"
    context = lambda r: f"substr({text}, greatest({r}.s - {d.window}, 0) + 1, least({r}.s, {d.window}))"
    tests = [f"{y}.v <> ''"] if groups else []
    if d.check:
        tests.append(CHECKS[d.check](f"{y}.v"))
    if d.where:
        tests.append("(" + d.where.format(v=f"{y}.v", g1=f"{y}.g1", g2=f"{y}.g2") + ")")
    if d.suppress:
        tests.append(f"NOT {context(y)} RLIKE {quoted(d.suppress)}")
    if tests:
        rows = f"filter({rows}, {y} -> coalesce({' AND '.join(tests)}, false))"
    fields = (
        f"'type', {quoted(d.type)}, 'start', {z}.s, 'end', {z}.s + length({z}.v), 'value', {z}.v, "
        f"'confidence', {_confidence(d, f'{z}.v', context(z))}, 'detector', {quoted(d.name)}, 'ord', {number}"
    )
    out = f"transform({rows}, {z} -> named_struct({fields}))"
    if d.prefilter:
        out = f"CASE WHEN {' OR '.join(f'contains({text}, {quoted(p)})' for p in d.prefilter)} THEN {out} ELSE {NONE} END"
    return out


def all_findings(detectors: list[Detector], text: str) -> str:
    """Findings of all detectors, numbered by catalog order; null text has none."""
    groups: dict[str, list[str]] = {}
    for k, d in enumerate(detectors):
        groups.setdefault(d.needs, []).append(findings_of(d, k, text))
    each = [
        f"CASE WHEN {text} RLIKE {quoted(NEEDS[needs])} THEN concat({', '.join(own)}) ELSE {NONE} END" if needs else f"concat({', '.join(own)})"
        for needs, own in groups.items()
    ]
    return f"CASE WHEN {text} IS NULL THEN {NONE} ELSE concat({', '.join(each)}) END" if each else NONE


def filtered(found: str, min_confidence: float, only=None, exclude=(), allowlist=(), min_severity: str = "") -> str:
    """Findings that pass, by confidence, type, allowlist and severity.

    Wanted and unwanted types are upper-cased, finding types are not. An allowlist entry
    excuses every value that contains it, whatever the case.
    """
    f = name("f")
    tests = [f"{f}.confidence >= {float(min_confidence)}D"]
    listed = lambda ts: ", ".join(quoted(t) for t in sorted(ts)) or "NULL"
    if only is not None:
        tests.append(f"{f}.type IN ({listed({t.upper() for t in only})})")
    if exclude:
        tests.append(f"NOT {f}.type IN ({listed({t.upper() for t in exclude})})")
    tests += [f"NOT contains(lower({f}.value), {quoted(a.lower())})" for a in allowlist]
    least = severity_rank(min_severity)
    if least > 0:
        low = {t for t in CATEGORY_OF if severity_rank(severity_of(t)) < least}
        high = set(CATEGORY_OF) - low
        tests.append(f"NOT {f}.type IN ({listed(low)})" if least <= 1 else f"{f}.type IN ({listed(high)})")
    return f"filter({found}, {f} -> coalesce({' AND '.join(tests)}, false))"


def could_pass(d: Detector, min_confidence: float, only=None, exclude=()) -> bool:
    """False if none of the detector's findings can pass: it need not run at all."""
    return (
        d.most >= min_confidence
        and (only is None or d.type in {t.upper() for t in only})
        and d.type not in {t.upper() for t in exclude}
    )


def resolved(found: str) -> str:
    """Findings without overlaps, by start.

    Greedy by confidence, length, start, type and catalog order. Findings are first cut
    into clusters that cannot touch each other, so a finding is only ever held against its
    own cluster.
    """
    x, c, k, f, i = name("x"), name("c"), name("k"), name("f"), name("i")
    by_start = lambda v: f"array_sort(transform({v}, {f} -> named_struct('start', {f}.start, 'f', {f})))"

    def clusters(v: str) -> str:
        """Slices of the sorted findings between places where all before have ended."""
        def cut(r: str) -> str:
            ends = running(f"transform({r}, {f} -> {f}.f.end)", "greatest")

            def of(e: str) -> str:
                firsts = f"filter(sequence(0, size({r}) - 1), {i} -> {i} = 0 OR {r}[{i}].start >= {e}[{i} - 1])"
                return let(firsts, lambda at: (
                    f"transform({at}, ({x}, {i}) -> transform(slice({r}, {x} + 1, coalesce(get({at}, {i} + 1), size({r})) - {x}), {f} -> {f}.f))"))

            return let(ends, of)

        return let(by_start(v), cut)

    ranked = f"array_sort(transform({c}, {f} -> named_struct('a', -{f}.confidence, 'b', {f}.start - {f}.end, 'c', {f}.start, 'd', {f}.type, 'e', {f}.ord, 'f', {f})))"
    free = f"NOT exists({k}, {f} -> {f}.start < {x}.f.end AND {x}.f.start < {f}.end)"
    greedy = f"aggregate({ranked}, {NONE}, ({k}, {x}) -> CASE WHEN {free} THEN array_append({k}, {x}.f) ELSE {k} END)"
    ordered = f"transform(array_sort(transform({greedy}, {f} -> named_struct('s', {f}.start, 'f', {f}))), {f} -> {f}.f)"
    return let(found, lambda v: (
        f"CASE WHEN size({v}) < 2 THEN {v} ELSE flatten(transform({clusters(v)}, {c} -> CASE WHEN size({c}) < 2 THEN {c} ELSE {ordered} END)) END"))

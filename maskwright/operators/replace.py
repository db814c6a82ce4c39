"""Replacement strategies and reassembly, as SQL text over a text and its resolved findings."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from ..functions.text import let, name, quoted
from .names import EN_NAMES, RU_NAMES

STRATEGIES = ("placeholder", "pseudonym", "partial", "hash", "remove")
REVERSIBLE = {"placeholder", "pseudonym", "hash"}
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@dataclass(frozen=True)
class Strategy:
    """How a finding is replaced; an unknown name is a ValueError."""

    name: str = "placeholder"
    template: str = "[{type}_{n}]"
    key: str = ""
    visible: int = 4
    mask_char: str = "*"
    marker: str = ""

    def __post_init__(self):
        if self.name not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.name!r}; there are {', '.join(STRATEGIES)}")

    @property
    def reversible(self) -> bool:
        return self.name in REVERSIBLE

    def sql(self, f: str, n: str) -> str:
        """Replacement of finding ``f`` whose number within its type is ``n``."""
        if self.name == "placeholder":
            return _template(self.template, f, n)
        if self.name == "pseudonym":
            seed = f"concat({quoted(self.key)}, char(0), {f}.type, char(0), {f}.value)"
            return let(seed, lambda s: fake(f"{f}.type", f"{f}.value", s))
        if self.name == "partial":
            return partial_mask(f"{f}.value", self.visible, self.mask_char)
        if self.name == "hash":
            return f"concat('[', {f}.type, '_', substr(sha2(concat({quoted(self.key)}, char(0), {f}.value), 256), 1, 10), ']')"
        return quoted(self.marker)


def _template(template: str, f: str, n: str) -> str:
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(quoted(text))
        if field is not None:
            parts.append({"type": f"{f}.type", "n": f"cast({n} AS STRING)"}[field])
    return f"concat({', '.join(parts)})" if parts else "''"


def partial_mask(v: str, visible: int = 4, mask_char: str = "*") -> str:
    """All letters and digits masked but the last ``visible``; what stands between stays."""
    if visible <= 0:
        return f"regexp_replace({v}, '(?U)[\\\\p{{L}}\\\\p{{N}}]', {quoted(mask_char)})"
    ahead = f"(?=(?:[^\\\\p{{L}}\\\\p{{N}}]*[\\\\p{{L}}\\\\p{{N}}]){{{visible}}})"
    return f"regexp_replace({v}, '(?U)[\\\\p{{L}}\\\\p{{N}}]{ahead}', {quoted(mask_char)})"


def preview(v: str) -> str:
    """First character and a star for each other one; one character is a star."""
    return f"CASE WHEN length({v}) <= 1 THEN repeat('*', length({v})) ELSE concat(substr({v}, 1, 1), repeat('*', length({v}) - 1)) END"


# --- pseudonyms: a stream of bytes, sha256 of seed, NUL and a counter -------------------------
def stream(seed: str, n: str) -> str:
    """Array of at least ``n`` bytes."""
    c, i, h = name("c"), name("i"), name("h")
    block = f"sha2(concat({seed}, char(0), cast({c} AS STRING)), 256)"
    bytes_ = f"element_at(transform(array({block}), {h} -> transform(sequence(0, 31), {i} -> cast(conv(substr({h}, 2 * {i} + 1, 2), 16, 10) AS INT))), 1)"
    return f"flatten(transform(sequence(0, ({n} - 1) DIV 32), {c} -> {bytes_}))"


def _luhn_digit(body: str) -> str:
    """Check digit of an array of digits."""
    a, d, i = name("a"), name("d"), name("i")
    doubled = f"CASE WHEN {i} % 2 = 0 THEN cast(({d} * 2) DIV 10 AS INT) + ({d} * 2) % 10 ELSE {d} END"
    return f"(10 - aggregate(transform(reverse({body}), ({d}, {i}) -> {doubled}), 0, ({a}, {d}) -> {a} + {d}) % 10) % 10"


def fake_digits(v: str, seed: str, luhn: bool = False) -> str:
    """Digits replaced one by one, the rest kept; no leading zero; with ``luhn``, a valid check digit."""
    x, i, a = name("x"), name("i"), name("a")
    chars = f"transform(sequence(1, length({v})), {i} -> substr({v}, {i}, 1))"
    is_digit = lambda c: f"{c} RLIKE '(?U)^\\\\d$'"

    def placed(cs: str) -> str:
        count = f"size(filter({cs}, {x} -> {is_digit(x)}))"

        def given(raw: str) -> str:
            first = f"transform(slice({raw}, 1, {count}), ({x}, {i}) -> CASE WHEN {i} = 0 AND {x} % 10 = 0 THEN 1 ELSE {x} % 10 END)"

            def text(new: str) -> str:
                step = (
                    f"CASE WHEN {is_digit(x)} THEN named_struct('k', {a}.k + 1, 't', concat({a}.t, cast({new}[{a}.k] AS STRING))) "
                    f"ELSE named_struct('k', {a}.k, 't', concat({a}.t, {x})) END"
                )
                return f"aggregate({cs}, named_struct('k', 0, 't', ''), ({a}, {x}) -> {step}, {a} -> {a}.t)"

            if not luhn:
                return let(first, text)
            body = lambda d: f"slice({d}, 1, size({d}) - 1)"
            return let(first, lambda d: let(f"CASE WHEN size({d}) < 2 THEN {d} ELSE array_append({body(d)}, {_luhn_digit(body(d))}) END", text))

        return f"CASE WHEN {count} = 0 THEN {v} ELSE {let(stream(seed, count), given)} END"

    return f"CASE WHEN length({v}) = 0 THEN {v} ELSE {let(chars, placed)} END"


def fake_email(seed: str) -> str:
    x = name("x")
    return f"concat('user', array_join(transform(slice({stream(seed, '6')}, 1, 6), {x} -> cast({x} % 10 AS STRING)), ''), '@example.invalid')"


def fake_person(v: str, seed: str) -> str:
    """As many names as words, English if the first character is an ASCII letter, else Russian."""
    i = name("i")
    words = f"greatest(1, size(filter(split({v}, '(?U)\\\\s+'), w -> w <> '')))"

    def of(pool) -> str:
        titled = "array(" + ", ".join(quoted(n.title()) for n in pool) + ")"
        return let(stream(seed, f"2 * {words}"), lambda b: (
            f"array_join(transform(sequence(0, {words} - 1), {i} -> element_at({titled}, ({b}[2 * {i}] * 256 + {b}[2 * {i} + 1]) % {len(pool)} + 1)), ' ')"))

    return f"CASE WHEN {v} RLIKE '^[A-Za-z]' THEN {of(EN_NAMES)} ELSE {of(RU_NAMES)} END"


def fake_token(v: str, seed: str) -> str:
    """A fresh token as long, of letters and digits."""
    x = name("x")
    return f"array_join(transform(slice({stream(seed, f'greatest(1, length({v}))')}, 1, greatest(1, length({v}))), {x} -> substr('{ALNUM}', {x} % {len(ALNUM)} + 1, 1)), '')"


def fake(type_: str, v: str, seed: str) -> str:
    """A stand-in by type: card, email, phone, person; else digits if there is no letter, else a token."""
    return (
        f"CASE WHEN {type_} = 'CREDIT_CARD' THEN {fake_digits(v, seed, luhn=True)} WHEN {type_} = 'EMAIL' THEN {fake_email(seed)} "
        f"WHEN {type_} IN ('PHONE', 'PHONE_RU') THEN {fake_digits(v, seed)} WHEN {type_} = 'PERSON' THEN {fake_person(v, seed)} "
        f"WHEN NOT {v} RLIKE '(?U)\\\\p{{L}}' THEN {fake_digits(v, seed)} ELSE {fake_token(v, seed)} END"
    )


# --- reassembly ------------------------------------------------------------------------------
def replaced(found: str, strategy: Strategy) -> str:
    """Array of (start, end, type, value, replacement) of resolved findings.

    The number of a finding counts the distinct values of its type in order of appearance.
    """
    f, g, t, e = name("f"), name("g"), name("t"), name("e")

    def rows(v: str) -> str:
        pairs = f"array_distinct(transform({v}, {g} -> named_struct('type', {g}.type, 'value', {g}.value)))"

        def numbered(values: str) -> str:
            n = f"array_position(element_at({values}, {f}.type), {f}.value)"
            return f"transform({v}, {f} -> named_struct('start', {f}.start, 'end', {f}.end, 'type', {f}.type, 'value', {f}.value, 'replacement', {strategy.sql(f, n)}))"

        by_type = lambda p: (
            f"map_from_entries(transform(array_distinct(transform({p}, {g} -> {g}.type)), {t} -> "
            f"struct({t}, transform(filter({p}, {g} -> {g}.type = {t}), {e} -> {e}.value))))")  # fmt: skip
        return let(let(pairs, by_type), numbered)

    return let(found, rows)


def masked(text: str, rows: str) -> str:
    """The text with its findings replaced; ``rows`` as made by :func:`replaced`."""
    r, i, k = name("r"), name("i"), name("k")

    def pieces(v: str) -> str:
        # A place of a text is found from the text's start, so texts are first cut at every so many findings.
        size = f"cast(ceil(sqrt(size({v}))) AS INT)"

        def block(s: str) -> str:
            low = f"CASE WHEN {k} = 0 THEN 0 ELSE {v}[{k} * {size} - 1].end END"

            def of(lo: str) -> str:
                prev = f"CASE WHEN {i} = 0 THEN {lo} ELSE {s}[{i} - 1].end END"
                each = lambda chunk: f"transform({s}, ({r}, {i}) -> concat(substr({chunk}, ({prev}) - {lo} + 1, {r}.start - ({prev})), {r}.replacement))"
                return let(f"substr({text}, {lo} + 1, element_at({s}, -1).end - {lo})", lambda chunk: f"array_join({each(chunk)}, '')")

            return let(low, of)

        blocks = f"transform(sequence(0, cast((size({v}) - 1) DIV {size} AS INT)), {k} -> {let(f'slice({v}, {k} * {size} + 1, {size})', block)})"
        return f"CASE WHEN size({v}) = 0 THEN {text} ELSE concat(array_join({blocks}, ''), substr({text}, element_at({v}, -1).end + 1)) END"

    return let(rows, pieces)


def stats(rows: str) -> str:
    """Map of type to number of findings."""
    t, f = name("t"), name("f")
    return let(rows, lambda v: (
        f"map_from_entries(transform(array_distinct(transform({v}, {f} -> {f}.type)), {t} -> struct({t}, size(filter({v}, {f} -> {f}.type = {t})))))"))


def last_by_replacement(rows: str, field: str) -> str:
    """Map of replacement to a field; where two meet, the last wins. Each replacement's rows are sought only then."""
    f, g, k = name("f"), name("g"), name("k")

    def of(v: str) -> str:
        keys = f"array_distinct(transform({v}, {f} -> {f}.replacement))"
        pairs = f"array_distinct(transform({v}, {f} -> named_struct('k', {f}.replacement, 'v', {f}.{field})))"
        last = f"transform({keys}, {k} -> named_struct('k', {k}, 'v', element_at(filter({v}, {g} -> {g}.replacement = {k}), -1).{field}))"
        return let(pairs, lambda p: f"map_from_entries(CASE WHEN size({p}) = size({keys}) THEN {p} ELSE {last} END)")

    return let(rows, of)


def vault(rows: str) -> str:
    """Map of replacement to original; where two meet, the last wins."""
    return last_by_replacement(rows, "value")


def restored(text: str, vault_: str) -> str:
    """Originals put back, longest replacement first; empty replacements cannot be undone."""
    e, t = name("e"), name("t")
    order = f"transform(array_sort(transform(map_entries({vault_}), {e} -> named_struct('n', -length({e}.key), 'k', {e}.key, 'v', {e}.value))), {e} -> {e})"
    return f"aggregate({order}, {text}, ({t}, {e}) -> CASE WHEN {e}.k = '' THEN {t} ELSE replace({t}, {e}.k, {e}.v) END)"

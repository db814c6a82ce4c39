"""SQL text helpers.

Detection is one expression over a text column. It is put together as SQL text, because the
same text then works on a column, on a cell of an array, and on a lambda variable.
"""

from __future__ import annotations

import re
from itertools import count

_fresh = count()

#: A finding, as an element of an array column.
FINDING = "struct<type:string,start:int,end:int,value:string,confidence:double,detector:string,ord:int>"


def name(prefix: str = "v") -> str:
    """A lambda variable that no other uses."""
    return f"{prefix}{next(_fresh)}"


def quoted(text: str) -> str:
    """SQL string literal. Backslashes and quotes are escaped, the rest stands for itself."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body) -> str:
    """``body(v)`` with ``value`` computed once."""
    v = name()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def running(values: str, combine: str = "sum") -> str:
    """Array of the running sums, or with ``greatest`` the running maxima, of an array of ints.

    Appending to an array copies it, so runs are made in blocks of about the root of the
    length, and each block is then raised by what came before it.
    """
    a, x, b, i, k = name("a"), name("x"), name("b"), name("i"), name("k")
    both = (lambda p, q: f"{p} + {q}") if combine == "sum" else (lambda p, q: f"greatest({p}, {q})")
    least = "0" if combine == "sum" else "-2147483648"
    none = "cast(array() as array<int>)"
    fold = lambda s: f"aggregate({s}, {none}, ({a}, {x}) -> array_append({a}, {both(f'coalesce(get({a}, size({a}) - 1), {least})', x)}))"

    def blocks(v: str) -> str:
        def of(size: str) -> str:
            each = f"transform(sequence(0, cast((size({v}) - 1) DIV {size} AS INT)), {k} -> {fold(f'slice({v}, {k} * {size} + 1, {size})')})"
            return let(each, raised)

        return let(f"cast(ceil(sqrt(size({v}))) AS INT)", of)

    def raised(bs: str) -> str:
        lasts = fold(f"transform({bs}, {b} -> element_at({b}, -1))")
        return let(lasts, lambda last: f"flatten(transform({bs}, ({b}, {i}) -> transform({b}, {x} -> {both(x, f'coalesce(get({last}, {i} - 1), {least})')})))")

    return let(values, lambda v: f"CASE WHEN size({v}) = 0 THEN {none} ELSE {blocks(v)} END")


_first = re.compile(r"(?:\\b|\(\?<![^)]*\))(?:\(\?:)?(\\d|\[(?:[^\]\\]|\\.)+\]|[A-Za-z0-9])(?![?*|])")


def quick(pattern: str) -> str:
    """The pattern, with a look at the first character before the border or look-behind it starts with.

    Where a match must start with a certain class of characters, most places then fail at
    once, without the dearer test. Patterns with alternatives at the top are left alone.
    """
    m = _first.match(pattern)
    depth = top = 0
    for k, c in enumerate(pattern):
        escaped = k and pattern[k - 1] == "\\" and not (k > 1 and pattern[k - 2] == "\\")
        depth += (c == "(") - (c == ")") if not escaped else 0
        top += c == "|" and (depth == 0 or depth == 1 and bool(m) and "(?:" in m.group())
    return f"(?={m.group(1)}){pattern}" if m and not top else pattern


def matches(text: str, pattern: str, groups: tuple[int, ...] = (), flags: str = "(?U)") -> str:
    """Leftmost non-overlapping matches: array of struct(at, v, g1, ...), offsets in code points.

    ``groups`` are capture groups wanted besides the whole match. The places come from the
    lengths of the pieces between matches, which ``split`` gives by the same pattern, so no
    character is reserved as a marker. Texts without a match are matched once and not split.
    """
    rx = quoted(flags + quick(pattern))

    def placed(found: str) -> str:
        i, x, k, p, q = name("i"), name("x"), name("k"), name("p"), name("q")
        total = lambda steps, first, n: f"aggregate(slice({steps}, {first} + 1, {n}), 0, ({p}, {q}) -> {p} + {q})"

        def rows(steps: str, heads: str, held: tuple[str, ...] = ()) -> str:
            if len(held) < len(groups):
                return let(f"regexp_extract_all({text}, {rx}, {groups[len(held)]})", lambda g: rows(steps, heads, (*held, g)))
            fields = "".join(f", {h}[{i}] as g{g}" for g, h in zip(groups, held))
            at = f"{heads}[shiftright({i}, 7)] + {total(steps, f'{i} - {i} % 128', f'{i} % 128 + 1')}"
            return f"transform({found}, ({x}, {i}) -> struct({at} as at, {x} as v{fields}))"

        def sums(steps: str) -> str:
            """The sum before every 128th step, so that no place needs more than the steps since."""
            after = total(steps, f"{k} * 128", "128")
            heads = f"aggregate(sequence(0, shiftright(size({steps}), 7)), array(0), ({x}, {k}) -> array_append({x}, {x}[{k}] + {after}))"
            return let(heads, lambda h: rows(steps, h))

        def steps(gaps: str) -> str:
            return let(f"transform({found}, ({x}, {i}) -> length({gaps}[{i}]) + CASE WHEN {i} = 0 THEN 0 ELSE length({found}[{i} - 1]) END)", sums)

        return let(f"split({text}, {rx}, -1)", steps)

    empty = "cast(array() as array<struct<at:int,v:string" + "".join(f",g{g}:string" for g in groups) + ">>)"
    return let(f"regexp_extract_all({text}, {rx}, 0)", lambda f: f"CASE WHEN size({f}) = 0 THEN {empty} ELSE {placed(f)} END")

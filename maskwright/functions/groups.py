"""Where a capture group begins within a match, for regular expressions whose engine does not tell.

What a match holds before the group is captured too, so the group's place is the sum of the
lengths of those captures.
"""

from __future__ import annotations

import re


def _parts(pattern: str) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Closing parenthesis of each opening one, places of capturing ones, of top bars of each level, and of back references."""
    closes, captures, bars, references, opened = {}, [], [], [], []
    k = in_class = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if pattern[k + 1 : k + 2] in ("Q", "E"):
                raise ValueError("a pattern with a group must not quote by \\Q")
            if pattern[k + 1 : k + 2] in tuple("123456789") and not in_class:
                references.append(k)
            k += 1
        elif c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class and c == "(":
            opened.append(k)
            if pattern[k + 1 : k + 2] != "?" or re.match(r"\(\?<[A-Za-z]", pattern[k:]):
                captures.append(k)
        elif not in_class and c == ")" and opened:
            closes[opened.pop()] = k
        elif not in_class and c == "|":
            bars.append(k)
        k += 1
    return closes, captures, bars, references


def with_place(pattern: str, group: int) -> tuple[str, int, tuple[int, ...]]:
    """The pattern with captures added, the group's new number, and those whose lengths add up to its place in the match.

    A group in a repeated part or in a look-behind has no such place: ValueError.
    """
    closes, captures, bars, references = _parts(pattern)
    if not 1 <= group <= len(captures):
        raise ValueError(f"the pattern has no group {group}")
    at = captures[group - 1]
    path = sorted(o for o, c in closes.items() if o <= at < c)
    cuts = []
    for level, inner in zip([-1, *path], path):
        repeat = pattern[closes[inner] + 1 : closes[inner] + 2]
        if repeat and repeat in "*+{" or pattern.startswith(("(?<=", "(?<!"), inner):
            raise ValueError("the group of a custom pattern must not be repeated, nor in a repeated part or a look-behind")
        own = [b for b in bars if level < b < inner and not any(level < o < b < c for o, c in closes.items())]
        head = re.match(r"\((?:\?(?:[:=!>]|<[A-Za-z]\w*>|[a-zA-Z-]+:))?", pattern[level:]) if level >= 0 else None
        start = own[-1] + 1 if own else level + head.end() if head else 0
        start += re.match(r"(?:\(\?[a-zA-Z-]+\))*", pattern[start:]).end()  # flags must stay in force
        if re.search(r"\(\?[a-zA-Z-]+\)", pattern[start:inner]):
            raise ValueError("flags of a custom pattern with a group must stand at its start")
        if start < inner:
            cuts.append((start, inner))
    number = lambda place: 1 + sum(o < place for o in captures) + sum(s <= place for s, _ in cuts)
    edits = [(s, "(") for s, _ in cuts] + [(e, ")") for _, e in cuts]
    out, last = [], 0
    for place, mark in sorted(edits + [(r, "") for r in references], key=lambda x: (x[0], x[1] == "(")):
        out += [pattern[last:place], mark]
        last = place
        if not mark:
            old = re.match(r"\\(\d+)", pattern[place:])
            wanted = int(old[1])
            while wanted > len(captures) and wanted > 9:
                wanted //= 10
            rest = old[1][len(str(wanted)) :]
            new = number(captures[wanted - 1]) if wanted <= len(captures) else wanted
            out.append(f"\\{new}(?:){rest}" if rest or pattern[place + old.end() : place + old.end() + 1].isdigit() else f"\\{new}")
            last = place + old.end()
    out.append(pattern[last:])
    before = tuple(1 + sum(o < s for o in captures) + sum(t < s for t, _ in cuts) for s, _ in cuts)
    return "".join(out), number(at), before

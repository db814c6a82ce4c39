"""Checksum and structure tests of identifiers, as SQL text over a string.

Each function takes SQL for the value and returns SQL for a boolean. Full-width digits count
as digits. Values of the wrong length or shape are false, never an error.
"""

from __future__ import annotations

from .text import let, quoted

FULL_WIDTH = "０１２３４５６７８９"


def ascii_digits(v: str) -> str:
    return f"translate({v}, '{FULL_WIDTH}', '0123456789')"


def digits(v: str) -> str:
    """All digits of a value, in order."""
    return f"regexp_replace({ascii_digits(v)}, '[^0-9]', '')"


def at(d: str, i: int) -> str:
    """Digit number ``i`` from 0."""
    return f"try_cast(substr({d}, {i + 1}, 1) AS INT)"


def weighted(d: str, weights, first: int = 0) -> str:
    """Sum of digits times weights, from digit ``first`` on."""
    return "(" + " + ".join(f"{at(d, first + i)} * {w}" for i, w in enumerate(weights)) + ")"


def _of(v: str, length: int, body) -> str:
    """Test ``body`` of the digits if there are ``length`` of them."""
    return let(digits(v), lambda d: f"CASE WHEN length({d}) = {length} THEN coalesce({body(d)}, false) ELSE false END")


def _ints(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def always(v: str) -> str:
    return "true"


def luhn(v: str) -> str:
    return let(digits(v), lambda d: f"(length({d}) >= 2 AND luhn_check({d}))")


def card(v: str) -> str:
    """13 to 19 digits of an issuer from 2 to 6, not all the same, passing Luhn."""
    return let(digits(v), lambda d: (
        f"(length({d}) BETWEEN 13 AND 19 AND substr({d}, 1, 1) BETWEEN '2' AND '6' "
        f"AND {d} <> repeat(substr({d}, 1, 1), length({d})) AND luhn_check({d}))"))  # fmt: skip


def inn(v: str) -> str:
    # Weights of the check digits.
    ten, eleven, twelve = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    return let(ascii_digits(v), lambda d: (
        f"CASE WHEN NOT {d} RLIKE '^[0-9]+$' THEN false WHEN length({d}) = 10 THEN {weighted(d, ten)} % 11 % 10 = {at(d, 9)} "
        f"WHEN length({d}) = 12 THEN {weighted(d, eleven)} % 11 % 10 = {at(d, 10)} AND {weighted(d, twelve)} % 11 % 10 = {at(d, 11)} ELSE false END"))  # fmt: skip


def snils(v: str) -> str:
    """Weighted sum modulo 101, 100 counting as 0; low numbers have no check."""
    def body(d: str) -> str:
        s = weighted(d, range(9, 0, -1))
        rest = f"CASE WHEN {s} % 101 = 100 THEN 0 ELSE {s} % 101 END"
        return f"(try_cast(substr({d}, 1, 9) AS INT) <= 1001998 OR {rest} = try_cast(substr({d}, 10, 2) AS INT))"
    return _of(v, 11, body)


def iban(v: str) -> str:
    """Letters as two-digit numbers, first four characters last, modulo 97 equal to 1."""
    step = "(a, c) -> CASE WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END"
    chars = lambda s: f"transform(sequence(1, length({s})), i -> substr(concat(substr({s}, 5), substr({s}, 1, 4)), i, 1))"
    compact = rf"upper(regexp_replace({v}, '(?U)\\s+', ''))"
    return let(compact, lambda s: f"CASE WHEN {s} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}$' THEN aggregate({chars(s)}, 0, {step}) = 1 ELSE false END")


def _ogrn(v: str, n: int, modulus: int) -> str:
    return let(ascii_digits(v), lambda d: f"CASE WHEN {d} RLIKE '^[0-9]{{{n}}}$' THEN try_cast(substr({d}, 1, {n - 1}) AS BIGINT) % {modulus} % 10 = {at(d, n - 1)} ELSE false END")


def ogrn(v: str) -> str:
    return _ogrn(v, 13, 11)


def ogrnip(v: str) -> str:
    return _ogrn(v, 15, 13)


def verhoeff(d: str) -> str:
    """The dihedral-group check of a digit string; its tables are built from their rules."""
    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5
    turn = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # Fixed values: the permutation applied once a place.
    powers = [tuple(range(10))]
    for _ in range(7):
        powers.append(tuple(turn[p] for p in powers[-1]))
    table = _ints(product(a, b) for a in range(10) for b in range(10))
    perms = _ints(p for row in powers for p in row)
    digit = f"try_cast(substr({d}, length({d}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (c, i) -> element_at({table}, c * 10 + element_at({perms}, i % 8 * 10 + {digit} + 1) + 1)) = 0"


def aadhaar(v: str) -> str:
    return _of(v, 12, lambda d: f"(substr({d}, 1, 1) NOT IN ('0', '1') AND {verhoeff(d)})")


def nhs(v: str) -> str:
    return _of(v, 10, lambda d: f"CASE (11 - {weighted(d, range(10, 1, -1))} % 11) WHEN 10 THEN false WHEN 11 THEN {at(d, 9)} = 0 ELSE {at(d, 9)} = 11 - {weighted(d, range(10, 1, -1))} % 11 END")


def pesel(v: str) -> str:
    return _of(v, 11, lambda d: f"(10 - {weighted(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))} % 10) % 10 = {at(d, 10)}")


def china_id(v: str) -> str:
    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)  # Fixed values.
    body = lambda s: f"CASE WHEN {s} RLIKE '^[0-9]{{17}}[0-9X]$' THEN substr('10X98765432', {weighted(s, weights)} % 11 + 1, 1) = substr({s}, 18, 1) ELSE false END"
    return let(f"upper(trim({ascii_digits(v)}))", body)


def aba(v: str) -> str:
    return _of(v, 9, lambda d: f"{weighted(d, (3, 7, 1) * 3)} % 10 = 0")


#: Fixed value: control letters by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(s: str, number: str) -> str:
    return f"substr('{DNI_LETTERS}', try_cast({number} AS INT) % 23 + 1, 1) = substr({s}, 9, 1)"


def dni_es(v: str) -> str:
    return let(f"upper(trim({ascii_digits(v)}))", lambda s: f"CASE WHEN {s} RLIKE '^[0-9]{{8}}[A-Z]$' THEN {_dni(s, f'substr({s}, 1, 8)')} ELSE false END")


def nie_es(v: str) -> str:
    number = lambda s: f"concat(translate(substr({s}, 1, 1), 'XYZ', '012'), substr({s}, 2, 7))"
    return let(f"upper(trim({ascii_digits(v)}))", lambda s: f"CASE WHEN {s} RLIKE '^[XYZ][0-9]{{7}}[A-Z]$' THEN {_dni(s, number(s))} ELSE false END")


def codice_fiscale(v: str) -> str:
    # What a character counts at odd places, by its digit or its place in the alphabet.
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
    def body(s: str) -> str:
        place = f"(ascii(substr({s}, i, 1)) - CASE WHEN substr({s}, i, 1) >= 'A' THEN 65 ELSE 48 END)"
        total = f"aggregate(sequence(1, 15), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN element_at({_ints(odd)}, {place} + 1) ELSE {place} END)"
        return f"CASE WHEN {s} RLIKE '^[A-Z0-9]{{16}}$' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {total} % 26 + 1, 1) = substr({s}, 16, 1) ELSE false END"
    return let(f"upper(trim({ascii_digits(v)}))", body)


def de_taxid(v: str) -> str:
    """ISO 7064 MOD 11,10; no leading zero."""
    def body(d: str) -> str:
        step = f"(p, i) -> (CASE WHEN (p + try_cast(substr({d}, i, 1) AS INT)) % 10 = 0 THEN 10 ELSE (p + try_cast(substr({d}, i, 1) AS INT)) % 10 END) * 2 % 11"
        return f"(substr({d}, 1, 1) <> '0' AND (11 - aggregate(sequence(1, 10), 10, {step})) % 10 = {at(d, 10)})"
    return _of(v, 11, body)


def fr_nir(v: str) -> str:
    """97 minus the body modulo 97; Corsican departments count as 19 and 18."""
    raw = rf"upper(regexp_replace({ascii_digits(v)}, '(?U)\\s', ''))"
    number = lambda s: f"replace(replace(substr({s}, 1, 13), '2A', '19'), '2B', '18')"
    return let(raw, lambda s: (
        f"(length({s}) = 15 AND {number(s)} RLIKE '^[0-9]{{13}}$' AND substr({s}, 14) RLIKE '^[0-9]{{2}}$' "
        f"AND coalesce(97 - try_cast({number(s)} AS BIGINT) % 97 = try_cast(substr({s}, 14) AS INT), false))"))  # fmt: skip


#: Fixed value: the base-58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def tron(v: str) -> str:
    """Base-58 with checksum, version byte 0x41: 25 bytes, kept lowest first while decoding."""
    step = (
        f"aggregate(b, named_struct('k', cast(instr('{BASE58}', c) - 1 AS BIGINT), 'o', cast(array() as array<int>)), "
        "(s, x) -> named_struct('k', (s.k + x * 58) DIV 256, 'o', array_append(s.o, cast((s.k + x * 58) % 256 AS INT))))"
    )

    def body(s: str) -> str:
        chars = f"transform(sequence(1, 34), i -> substr({s}, i, 1))"
        raw = f"aggregate({chars}, array_repeat(0, 25), (b, c) -> {step}.o)"
        text = lambda r: f"array_join(transform(reverse({r}), x -> lpad(hex(x), 2, '0')), '')"
        return let(text(raw), lambda h: (
            f"(substr({h}, 1, 2) = '41' AND substr({h}, 43, 8) = upper(substr(sha2(unhex(sha2(unhex(substr({h}, 1, 42)), 256)), 256), 1, 8)))"))
    return f"CASE WHEN {v} RLIKE '^T[{BASE58}]{{33}}$' THEN {body(v)} ELSE false END"


def _not_uniform(d: str) -> str:
    return f"{d} <> repeat(substr({d}, 1, 1), length({d}))"


def cpf(v: str) -> str:
    test = lambda d, n: f"{weighted(d, range(n + 1, 1, -1))} * 10 % 11 % 10 = {at(d, n)}"
    return _of(v, 11, lambda d: f"({_not_uniform(d)} AND {test(d, 9)} AND {test(d, 10)})")


def cnpj(v: str) -> str:
    weights = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)  # Fixed values; the first check leaves the first out.
    def test(d: str, w, n: int) -> str:
        return f"CASE WHEN {weighted(d, w)} % 11 < 2 THEN 0 ELSE 11 - {weighted(d, w)} % 11 END = {at(d, n)}"
    return _of(v, 14, lambda d: f"({_not_uniform(d)} AND {test(d, weights[1:], 12)} AND {test(d, weights, 13)})")


def sin_ca(v: str) -> str:
    return _of(v, 9, lambda d: f"luhn_check({d})")


def tfn_au(v: str) -> str:
    weights = (1, 4, 3, 7, 5, 8, 6, 9, 10)  # Fixed values.
    return let(digits(v), lambda d: (
        f"CASE length({d}) WHEN 8 THEN {weighted(d, weights[:8])} % 11 = 0 WHEN 9 THEN {weighted(d, weights)} % 11 = 0 ELSE false END"))


def mynumber_jp(v: str) -> str:
    w = (*range(2, 8), *range(2, 7))
    return _of(v, 12, lambda d: f"CASE WHEN {weighted(d, w)} % 11 <= 1 THEN 0 ELSE 11 - {weighted(d, w)} % 11 END = {at(d, 11)}")


def rrn_kr(v: str) -> str:
    return _of(v, 13, lambda d: f"(11 - {weighted(d, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10 = {at(d, 12)}")


def curp_mx(v: str) -> str:
    alphabet = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"  # Fixed value.
    shape = "^[A-Z][AEIOUX][A-Z]{2}[0-9]{6}[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9][0-9]$"
    total = lambda s: f"aggregate(sequence(1, 17), 0, (a, i) -> a + (instr('{alphabet}', substr({s}, i, 1)) - 1) * (19 - i))"
    return let(f"upper(trim({ascii_digits(v)}))", lambda s: f"CASE WHEN {s} RLIKE '{shape}' THEN (10 - {total(s)} % 10) % 10 = {at(s, 17)} ELSE false END")


def vin(v: str) -> str:
    # What letters stand for, and the weights of the places.
    letters, numbers, weights = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789", (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
    def body(s: str) -> str:
        return let(f"translate({s}, '{letters}', '{numbers}')", lambda d: (
            f"substr({s}, 9, 1) = CASE WHEN {weighted(d, weights)} % 11 = 10 THEN 'X' ELSE cast({weighted(d, weights)} % 11 AS STRING) END"))
    return let(f"upper(trim({ascii_digits(v)}))", lambda s: f"CASE WHEN {s} RLIKE '^[A-HJ-NPR-Z0-9]{{17}}$' THEN {body(s)} ELSE false END")


def entropy(v: str) -> str:
    """Shannon entropy in bits a character; 0 for the empty string."""
    chars = f"transform(sequence(1, length({v})), i -> substr({v}, i, 1))"
    share = lambda cs, c: f"size(filter({cs}, x -> x = {c})) / size({cs})"
    return f"CASE WHEN length({v}) = 0 THEN 0D ELSE " + let(chars, lambda cs: f"aggregate(array_distinct({cs}), 0D, (a, c) -> a - ({share(cs, 'c')}) * log2({share(cs, 'c')}))") + " END"


def high_entropy(v: str) -> str:
    return f"(length({v}) >= 20 AND {entropy(v)} > 4.0)"


#: Tests by the name that catalog rows and custom detectors use.
CHECKS = {
    f.__name__: f
    for f in (luhn, card, inn, snils, iban, ogrn, ogrnip, aadhaar, nhs, pesel, china_id, aba, dni_es, nie_es, codice_fiscale, de_taxid,
              fr_nir, tron, cpf, cnpj, sin_ca, tfn_au, mynumber_jp, rrn_kr, curp_mx, vin, high_entropy)
}
CHECKS["verhoeff"] = lambda v: let(digits(v), lambda d: f"(length({d}) > 0 AND {verhoeff(d)})")


def check(kind: str, column: str) -> str:
    """SQL of a named test over a column; null values are false."""
    return f"coalesce({CHECKS[kind](f'cast({column} AS STRING)')}, false)"


__all__ = ["CHECKS", "check", "entropy", "digits", "quoted"]

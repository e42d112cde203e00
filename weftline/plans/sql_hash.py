"""XXH64 with seed 0 written in SQL, so that hashes and seeded orders can be checked by a database that lacks the function."""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = "18446744073709551616::uhugeint"


def _n(value: int) -> str:
    return f"{value}::uhugeint"


def _rotl(x: str, r: int) -> str:
    return f"((({x}) * {_n(2**r)}) % {_M} + ({x}) // {_n(2 ** (64 - r))})"


def _round(v: str, lane: str) -> str:
    return f"({_rotl(f'({v} + ({lane}) * {_n(P2)} % {_M}) % {_M}', 31)} * {_n(P1)} % {_M})"


def _mixed(h: str, v: str) -> str:
    return f"((xor({h}, {_round(_n(0), v)}) * {_n(P1)} + {_n(P4)}) % {_M})"


def _fold(start: str, parts: str, step: str) -> str:
    """step in h and k over the list `parts`."""
    return f"list_reduce(list_prepend({start}, {parts}), lambda h, k: {step})"


def with_xxh64(relation: str, text: str, name: str) -> str:
    """A query that adds the hash of the text (an expression over the relation) as a column; a null text has none."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(_x, {at}, 1)) - 1)"
    # powers of 256 as a list: whole numbers of 64 bits can't be taken from floating point
    powers = "[" + ", ".join(_n(256**k) for k in range(8)) + "]"
    lane = lambda at, n: f"list_reduce(list_prepend({_n(0)}, list_transform(range(0, {n}), lambda j: _b[({at}) + j + 1]::uhugeint * {powers}[j + 1])), lambda p, q: p + q)"
    stripes = lambda j: f"list_transform(range(0, _n // 32), lambda s: {lane(f's * 32 + {8 * j}', 8)})"
    starts = ((P1 + P2) % 2**64, P2, 0, (2**64 - P1) % 2**64)
    lanes = ", ".join(f"{_fold(_n(s), stripes(j), _round('h', 'k'))} as _v{j}" for j, s in enumerate(starts))
    sum_ = " + ".join(_rotl(f"_v{j}", r) for j, r in enumerate((1, 7, 12, 18)))
    steps = [
        f"select *, hex(encode({text})) as _x, octet_length(encode({text})) as _n from {relation}",
        f"select *, list_transform(range(1, _n + 1), lambda i: {digit('2 * i - 1')} * 16 + {digit('2 * i')}) as _b from (%s)",
        f"select *, {lanes} from (%s)",
        f"select *, ({sum_}) % {_M} as _h0 from (%s)",
        f"select *, {_mixed('_h0', '_v0')} as _h1 from (%s)",
        f"select *, {_mixed('_h1', '_v1')} as _h2 from (%s)",
        f"select *, {_mixed('_h2', '_v2')} as _h3 from (%s)",
        f"select *, ((case when _n >= 32 then {_mixed('_h3', '_v3')} else {_n(P5)} end) + _n::uhugeint) % {_M} as _h4 from (%s)",
        f"select *, {_fold('_h4', 'list_transform(range(0, _n % 32 // 8), lambda s: ' + lane('_n // 32 * 32 + s * 8', 8) + ')', '(' + _rotl('xor(h, ' + _round(_n(0), 'k') + ')', 27) + f' * {_n(P1)} + {_n(P4)}) % {_M}')} as _h5 from (%s)",
        f"select *, case when _n % 8 >= 4 then ({_rotl('xor(_h5, ' + lane('_n // 8 * 8', 4) + f' * {_n(P1)} % {_M})', 23)} * {_n(P2)} + {_n(P3)}) % {_M} else _h5 end as _h6 from (%s)",
        f"select *, {_fold('_h6', 'list_transform(range(_n // 4 * 4, _n), lambda i: _b[i + 1]::uhugeint)', _rotl(f'xor(h, k * {_n(P5)} % {_M})', 11) + f' * {_n(P1)} % {_M}')} as _h7 from (%s)",
        f"select *, xor(_h7, _h7 // {_n(2**33)}) * {_n(P2)} % {_M} as _h8 from (%s)",
        f"select *, xor(_h8, _h8 // {_n(2**29)}) * {_n(P3)} % {_M} as _h9 from (%s)",
        f"select * exclude (_x, _n, _b, _v0, _v1, _v2, _v3, _h0, _h1, _h2, _h3, _h4, _h5, _h6, _h7, _h8, _h9), xor(_h9, _h9 // {_n(2**32)})::decimal(20,0) as {name} from (%s)",
    ]
    out = steps[0]
    for s in steps[1:]:
        out = s.replace("%s", out)
    return out


def with_pair_xxh64(relation: str, a: str, b: str, name: str) -> str:
    """The same of two 64-bit numbers (expressions), as the 16 bytes that hold them in little-endian order."""
    merge = lambda h, k: f"({_rotl(f'xor({h}, {_round(_n(0), k)})', 27)} * {_n(P1)} + {_n(P4)}) % {_M}"
    steps = [
        f"select *, ({a})::uhugeint as _a, ({b})::uhugeint as _b from {relation}",
        f"select *, {merge(_n(P5 + 16), '_a')} as _h0 from (%s)",
        f"select *, {merge('_h0', '_b')} as _h1 from (%s)",
        f"select *, xor(_h1, _h1 // {_n(2**33)}) * {_n(P2)} % {_M} as _h2 from (%s)",
        f"select *, xor(_h2, _h2 // {_n(2**29)}) * {_n(P3)} % {_M} as _h3 from (%s)",
        f"select * exclude (_a, _b, _h0, _h1, _h2, _h3), xor(_h3, _h3 // {_n(2**32)})::decimal(20,0) as {name} from (%s)",
    ]
    out = steps[0]
    for s in steps[1:]:
        out = s.replace("%s", out)
    return out

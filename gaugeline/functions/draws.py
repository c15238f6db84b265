"""Random numbers that any engine can repeat: a mixed counter of 32 bits, so that resampling has SQL."""

from __future__ import annotations

#: Odd multipliers of a 32-bit mixing function with two rounds (published, found by search).
FIRST, SECOND = 0x7FEB352D, 0x846CA68B


def mixed(v):
    """Of an array of numbers below 2 ** 32."""
    import numpy as np

    one = np.uint64
    v = v.astype(one)
    v = ((v ^ (v >> one(16))) * one(FIRST)) & one(0xFFFFFFFF)
    v = ((v ^ (v >> one(15))) * one(SECOND)) & one(0xFFFFFFFF)
    return v ^ (v >> one(16))


def numbers(seed: int, draws: range, many: int):
    """A row of `many` numbers per draw."""
    import numpy as np

    base = mixed((np.arange(draws.start, draws.stop, dtype=np.uint64) + np.uint64(seed)) & np.uint64(0xFFFFFFFF))
    return mixed((base[:, None] + np.arange(many, dtype=np.uint64)) & np.uint64(0xFFFFFFFF))


def picks(seed: int, draws: range, many: int, n: int):
    """`many` of the numbers 0 to n - 1 per draw, with replacement."""
    import numpy as np

    return (numbers(seed, draws, many) % np.uint64(n)).astype(np.int64)


def mixed_sql(x: str) -> str:
    def let(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda v: {body})[1]"

    start = f"CAST(({x}) % 4294967296 AS UBIGINT)"
    one = let(start, f"(xor(v, v >> 16) * {FIRST}::UBIGINT) % 4294967296::UBIGINT")
    two = let(one, f"(xor(v, v >> 15) * {SECOND}::UBIGINT) % 4294967296::UBIGINT")
    return let(two, "xor(v, v >> 16)")


def number_sql(seed: str, draw: str, k: str) -> str:
    return mixed_sql(f"CAST({mixed_sql(f'{draw} + {seed}')} AS BIGINT) + {k}")


def pick_sql(seed: str, draw: str, k: str, n: str) -> str:
    return f"CAST({number_sql(seed, draw, k)} % CAST({n} AS UBIGINT) AS BIGINT)"

"""Edit distance and symmetric-delete neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``, or ``limit + 1`` if there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    # common ends never need an edit
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    a, b = a[i:la], b[i:lb]
    la, lb = len(a), len(b)
    if not la or not lb:
        return min(max(la, lb), limit + 1)
    # all cells of a row at once, one bit a letter
    full = (1 << la) - 1
    top = 1 << (la - 1)
    at: dict[str, int] = {}
    for x in range(la):
        at[a[x]] = at.get(a[x], 0) | 1 << x
    up, down, zero, last, dist = full, 0, 0, 0, la
    for y in range(lb):
        hit = at.get(b[y], 0)
        swap = ((~zero & hit) << 1) & last
        zero = ((((hit & up) + up) ^ up) | hit | down | swap) & full
        plus = down | (full & ~(zero | up))
        minus = zero & up
        if plus & top:
            dist += 1
        elif minus & top:
            dist -= 1
        if dist - (lb - 1 - y) > limit:
            return limit + 1
        plus = (plus << 1 | 1) & full
        up = ((minus << 1) & full) | (full & ~(zero | plus))
        down = plus & zero
        last = hit
    return min(dist, limit + 1)


def edit_bound(c: Column) -> Column:
    """Edits allowed for a token: none under four characters, one under eight, else two."""
    return F.when(F.length(c) < 4, 0).when(F.length(c) < 8, 1).otherwise(2)


def deletes(c: Column, wide: Column | None = None) -> Column:
    """Hashes of the token and of all strings that its edit bound of deletions leaves, or at most one deletion where
    ``wide`` is false. Tokens within the bound of each other share one; hashes may collide, so candidates are verified."""
    n = F.length(c)

    def cut(s: Column, i: Column) -> Column:
        return F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.length(s)))

    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: cut(c, i))

    def cut_two(i: Column, j: Column) -> Column:
        return F.concat(F.substring(c, F.lit(1), j), F.substring(c, j + 2, i - j - 1), F.substring(c, i + 2, n))

    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1),
        lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: cut_two(i, j))))
    none = F.array(c)
    every = F.when(n < 4, none).when((n < 8) if wide is None else (n < 8) | ~wide, F.concat(none, one)).otherwise(F.concat(none, one, two))
    return F.array_distinct(F.transform(every, lambda s: F.xxhash64(s)))

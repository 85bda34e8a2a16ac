"""IP addresses as points of the unit square, along a Z-order curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def v4(address: Column) -> Column:
    """The four numbers of an IPv4 address, or null."""
    parts = F.transform(F.split(address, r"\."), lambda p: F.when(p.rlike(r"^[+-]?[0-9]{1,9}$"), p.try_cast("int")))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce((p >= 0) & (p < 256), F.lit(False))), parts)


def v6(address: Column) -> Column:
    """The six numbers of an address of six groups of hexadecimal digits, or null; empty groups are 0, and an address that ends with :: is filled up with zeros."""
    bare = F.regexp_replace(address, ":+$", "")
    groups = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, ":"))
    parts = F.transform(groups, lambda p: F.when(p == "", F.lit(0).cast("long")).when(p.rlike("^[0-9a-fA-F]{1,7}$"), F.conv(p, 16, 10).try_cast("long")))
    valid = ((F.size(groups) == 6) | address.endswith("::")) & (F.size(groups) <= 6) & F.forall(parts, lambda p: F.coalesce(p <= 0xFFFF, F.lit(False)))
    return F.when(valid, F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("long"), 6)), 1, 6))


def _bound(value: Column, *steps) -> Column:
    """The steps one after another, each given the value of the one before, which is computed once."""
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return F.element_at(held, 1)


def _even(value: Column, bits: int) -> Column:
    """The even bits of a number of up to 16 bits, moved together."""

    def step(k: int, mask: int):
        return lambda v: v.bitwiseOR(F.shiftright(v, k)).bitwiseAND(mask)

    return _bound(value.bitwiseAND(0x5555), *[step(k, m) for k, m in ((1, 0x3333), (2, 0x0F0F), (4, 0x00FF)) if k < bits // 2])


def z_order(value: Column, bits: int) -> tuple[Column, Column]:
    """A number's even and odd bits, as two numbers."""
    value = value.cast("long")
    return _even(value, bits), _even(F.shiftright(value, 1), bits)


def on_curve(parts: Column, count: int, bits: int) -> tuple[Column, Column]:
    """x and y in the unit square of an array of numbers of so many bits."""
    whole, step = float(1 << (count * bits // 2)), 1 << (bits // 2)
    fold = lambda odd: F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * step + z_order(p, bits)[odd]) / whole
    return fold(0), fold(1)


def _of(parts: Column, count: int, bits: int) -> Column:
    return F.element_at(F.transform(F.array(parts), lambda p: F.when(p.isNotNull(), F.struct(*[c.alias(n) for c, n in zip(on_curve(p, count, bits), "xy")]))), 1)


def place(address: Column) -> Column:
    """A struct of x and y of an address of either kind, or null."""
    address = address.cast("string")
    return F.coalesce(_of(v4(address), 4, 8), _of(v6(address), 6, 16))


def to_point(address: Column) -> tuple[Column, Column]:
    """x and y of an address of either kind, or null."""
    at = place(address)
    return at["x"], at["y"]


#: The even bits of each byte, moved together; those of twice the byte are its odd ones.
_EVEN = [sum((b >> 2 * i & 1) << i for i in range(4)) for b in range(256)]


def with_points(df: DataFrame, **columns: str) -> DataFrame:
    """df with a struct of x and y for each column of addresses, in columns of the given names; each is computed once, wherever it is used."""
    even, odd = F.array(*map(F.lit, _EVEN)), F.array(*[F.lit(_EVEN[b >> 1]) for b in range(256)])
    for name, address in columns.items():
        text, parts = F.col(address).cast("string"), f"__{name}"
        # Step by step, so that the parts are split and read once; nothing but six groups leaves code generation.
        part = lambda i: F.get(F.col(parts), i)  # noqa: B023, E731
        numbers = [f"{parts}_{i}" for i in range(4)]
        df = df.withColumn(parts, F.split(text, r"\."))
        df = df.withColumns({n: F.when(part(i).rlike("^[+-]?[0-9]{1,9}$"), part(i).try_cast("int")) for i, n in enumerate(numbers)})
        valid = F.size(parts) == 4
        for n in numbers:
            valid &= F.coalesce((F.col(n) >= 0) & (F.col(n) < 256), F.lit(False))
        x, y = (sum(F.get(table, F.col(n)) * 16 ** (3 - i) for i, n in enumerate(numbers)) / 65536.0 for table in (even, odd))
        four = F.when(valid, F.struct(x.alias("x"), y.alias("y")))
        df = df.withColumn(name, F.explode(F.array(F.coalesce(four, _of(v6(text), 6, 16))))).drop(parts, *numbers)
    return df

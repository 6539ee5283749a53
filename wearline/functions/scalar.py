"""Scalar expressions: tokenising, strict parsing, guarded arithmetic, distances, the seeded generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295


#: A decimal number, inf or nan, as one field of a line.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"


#: White space as Unicode has it.
BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def fields(line: Column) -> Column:
    """array<string>: the runs of non-blank characters of a line; none for a blank line."""
    plain = ~line.rlike(r"[^\x20-\x7E]")  # one kind of blank, which splits several times as fast
    return F.filter(F.when(plain, F.split(line, " +")).otherwise(F.split(line, BLANKS)), lambda x: x != "")


def to_double(text: Column) -> Column:
    """A decimal number, inf or nan; null otherwise (no type suffixes such as 1d or 1.5f, no hexadecimals)."""
    number = text.try_cast("double")
    # of digits, points, signs and exponents alone the cast takes just what the pattern does
    return F.when(~text.rlike("[^0-9.eE+-]"), number).when(text.rlike(f"^{NUMBER}$"), number)


def to_u32(value: Column) -> Column:
    """A double cut towards zero and held to 0..2**32-1; nan is 0."""
    return F.when(F.isnan(value), F.lit(0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(float(U32))).cast("long")).cast("long")


def parse_u32(text: Column) -> Column:
    """A strict whole number 0..2**32-1; null otherwise."""
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("decimal(38,0)"))
    return F.when(number <= U32, number.cast("long"))


def z_score(value: Column, mean: Column, std: Column, least: float = 1e-9) -> Column:
    """(value - mean) / std, and exactly 0 where std is below ``least``."""
    return F.when(std < least, F.lit(0.0)).otherwise((value - mean) / std)


def squared_distance(point: Sequence[Column], centre: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal point, unrolled."""
    out = F.lit(0.0)
    for x, c in zip(point, centre):
        out = out + (x - F.lit(float(c))) * (x - F.lit(float(c)))
    return out


def nearest(point: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre; of equal distances the lowest index."""
    return F.array_min(F.array(*(F.struct(squared_distance(point, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))).getField("i")


class SplitMix64:
    """The public-domain splitmix64 generator; runs on the driver for a handful of draws."""

    # fixed values of the algorithm
    STEP, MIX_1, MIX_2, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 2**64 - 1

    def __init__(self, seed: int):
        self.state = seed & self.MASK

    def bits(self) -> int:
        self.state = (self.state + self.STEP) & self.MASK
        z = self.state
        z = ((z ^ (z >> 30)) * self.MIX_1) & self.MASK
        z = ((z ^ (z >> 27)) * self.MIX_2) & self.MASK
        return z ^ (z >> 31)

    def uniform(self) -> float:
        """A double in [0, 1)."""
        return (self.bits() >> 11) / (1 << 53)

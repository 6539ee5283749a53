"""Column layout of run-to-failure histories and the data sets' fixed facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import types as T

NUM_SETTINGS, NUM_SENSORS = 3, 21
NUM_FIELDS = 2 + NUM_SETTINGS + NUM_SENSORS
DEFAULT_CAP, DEFAULT_WINDOW = 125, 10
NEAR_CONSTANT_STD, ZERO_STD, ZERO_VARIATION = 1e-6, 1e-9, 1e-9


@dataclass(frozen=True)
class Layout:
    """Which columns make a run, its order, its settings and its sensors.

    ``order`` is total within a run, so that every window is deterministic.
    """

    run: tuple[str, ...] = ("unit",)
    order: tuple[str, ...] = ("cycle",)
    settings: tuple[str, ...] = tuple(f"op_setting_{i}" for i in range(1, NUM_SETTINGS + 1))
    sensors: tuple[str, ...] = tuple(f"sensor_{i}" for i in range(1, NUM_SENSORS + 1))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.run).orderBy(*self.order)

    def runs(self) -> WindowSpec:
        return Window.partitionBy(*self.run)

    def kept(self, excluded: list[int]) -> list[int]:
        """1-based numbers of the sensors that are not excluded."""
        return [i for i in range(1, len(self.sensors) + 1) if i not in set(excluded)]


#: Text files: a run is a unit of one subset and split, and equal cycles stay in file order.
FILES = Layout(run=("subset", "split", "unit"), order=("cycle", "line_no"))

CYCLES = T.StructType(
    [T.StructField("subset", T.StringType()), T.StructField("split", T.StringType()), T.StructField("unit", T.LongType()), T.StructField("cycle", T.LongType()), T.StructField("line_no", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in FILES.settings + FILES.sensors]
)

# Operating conditions, fault modes, training and test units of each subset.
SUBSETS = {
    "FD001": (1, 1, 100, 100),
    "FD002": (6, 1, 260, 259),
    "FD003": (1, 2, 100, 100),
    "FD004": (6, 2, 249, 248),
}


def subset_code(text: str) -> str:
    """'FD001' or '1', in any case -> 'FD001'."""
    code = text.upper()
    code = f"FD00{code}" if code in ("1", "2", "3", "4") else code
    if code not in SUBSETS:
        raise ValueError(f"unrecognized subset {text!r} (expected one of {', '.join(SUBSETS)})")
    return code


def subsets(spark: SparkSession) -> DataFrame:
    """The dimension table of the subsets: four rows."""
    rows = [(code, *facts) for code, facts in SUBSETS.items()]
    return spark.createDataFrame(rows, "subset string, conditions int, fault_modes int, train_units long, test_units long")

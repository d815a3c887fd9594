"""Table functions for SQL: framing, and perturbations that users bring along, over parts in the order of their samples.

SELECT * FROM frames(TABLE(x) PARTITION BY (group_id, part) ORDER BY (n), 16, 8)
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Columns of a table of samples that aren't keys.
SAMPLE = {"n": T.LongType(), "x": T.DoubleType()}


def keys_of(table: AnalyzeArgument) -> list[T.StructField]:
    if not isinstance(table.dataType, T.StructType) or not table.isTable:
        raise ValueError("the first argument is TABLE(...)")
    lacking = [c for c in SAMPLE if c not in table.dataType.names]
    if lacking:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    return [f for f in table.dataType.fields if f.name not in SAMPLE]


def whole_number(argument: AnalyzeArgument, name: str) -> int:
    if not isinstance(argument.value, int) or argument.value < 1:
        raise ValueError(f"{name} is a positive whole number")
    return argument.value


def places(row) -> tuple[int, int, list[int]]:
    """Where a row has n, x and its other columns: found once a part, for a look-up by name searches the names."""
    names = list(row.__fields__)
    return names.index("n"), names.index("x"), [i for i, c in enumerate(names) if c not in SAMPLE]


class Frames:
    """The samples of every full frame of `size` samples every `hop`: the table's other columns, idx, n, m (the place in the frame) and x. Samples come in order, from 0 without gaps;
    only a frame's samples are held."""

    def __init__(self):
        self.held, self.idx, self.at = [], 0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        whole_number(size, "size"), whole_number(hop, "hop")
        more = [T.StructField("idx", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()), T.StructField("x", T.DoubleType())]
        return AnalyzeResult(T.StructType([*keys_of(table), *more]))

    def eval(self, row, size: int, hop: int) -> Iterator[tuple]:
        if self.at is None:
            self.at = places(row)
        n, x, rest = self.at
        start = self.idx * hop
        if row[n] < start:
            return
        self.held.append(row)
        if len(self.held) == size:
            for m, r in enumerate(self.held):
                if r[n] != start + m:
                    raise ValueError(f"sample {start + m} is missing or out of order")
                yield (*[r[i] for i in rest], self.idx, r[n], m, float(r[x]))
            self.idx += 1
            self.held = self.held[hop:] if hop < size else []

    def terminate(self) -> Iterator[tuple]:
        self.held, self.idx = [], 0
        return iter(())


def perturbation(change: Callable[[np.ndarray, float], np.ndarray]) -> type:
    """A table function's class that gives every part's samples, changed by change(samples, strength), which keeps their number. A part is held as a whole: for recordings that a
    task holds."""

    class Perturbed:
        def __init__(self):
            self.rows: list = []
            self.strength = 0.0

        @staticmethod
        def analyze(table: AnalyzeArgument, strength: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(strength.value, int | float) and not hasattr(strength.value, "as_tuple"):
                raise ValueError("the strength is a number")
            return AnalyzeResult(T.StructType([*keys_of(table), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType())]))

        def eval(self, row, strength) -> None:
            self.rows.append(row)
            self.strength = float(strength)

        def terminate(self) -> Iterator[tuple]:
            n, at, rest = places(self.rows[0]) if self.rows else (0, 0, [])
            x = change(np.array([float(r[at]) for r in self.rows]), self.strength)
            if len(x) != len(self.rows):
                raise ValueError("a perturbation keeps the number of samples")
            for r, v in zip(self.rows, x.tolist(), strict=True):
                yield (*[r[i] for i in rest], r[n], v)

    return Perturbed


def register(spark: SparkSession, perturbations: dict[str, Callable[[np.ndarray, float], np.ndarray]] | None = None) -> None:
    """Registers frames() and a function for every perturbation, by its name."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that analyses a call on the driver is sent no package
    spark.udtf.register("frames", udtf(Frames))
    for name, change in (perturbations or {}).items():
        spark.udtf.register(name, udtf(perturbation(change)))

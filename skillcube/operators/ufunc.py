"""Functions of arrays over named dimensions, applied to every line, plane or box of a cube.

    apply_ufunc(cube, np.cumsum, "(time)->(time)", ["x"], ["total"], dims)
    apply_ufunc(cube, fit, "(time),(time)->(degree)", ["x", "y"], ["c"], dims, labels={"degree": [1, 0]})

A signature names the core dimensions of every input and output, as numpy's do. The other dimensions are looped over: a group of rows for each of
their combinations is packed into dense arrays, whose axes hold the core dimensions' labels in order, and what the function returns becomes rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcube.functions.weights import AXIS_LABELS


@dataclass(frozen=True)
class Signature:
    inputs: tuple[tuple[str, ...], ...]
    outputs: tuple[tuple[str, ...], ...]

    @property
    def core(self) -> list[str]:
        """Core dimensions of the inputs, in order of appearance."""
        return list(dict.fromkeys(d for i in self.inputs for d in i))


def parse(text: str) -> Signature:
    """'(time,level),(time)->(time),()' as core dimensions of inputs and outputs."""
    one = r"\(\s*(?:\w+\s*(?:,\s*\w+\s*)*)?\)"
    many = rf"{one}(?:\s*,\s*{one})*"
    if not re.fullmatch(rf"\s*{many}\s*->\s*{many}\s*", text):
        raise ValueError(f"cannot read the signature {text!r}")
    left, right = ([tuple(re.findall(r"\w+", g)) for g in re.findall(one, side)] for side in text.split("->"))
    for dims in (*left, *right):
        if len(set(dims)) != len(dims):
            raise ValueError(f"a dimension is named twice in {text!r}")
    return Signature(tuple(left), tuple(right))


def _axis(df: DataFrame, dim: str) -> list:
    found = sorted(r[0] for r in df.select(dim).where(F.col(dim).isNotNull()).distinct().limit(AXIS_LABELS + 1).collect())
    if len(found) > AXIS_LABELS:
        raise ValueError(f"{dim} is no axis: it has more than {AXIS_LABELS} labels")
    return found


def apply_ufunc(
    df: DataFrame, function: Callable, signature: str, inputs: Sequence[str], outputs: Sequence[str], dims: Sequence[str], labels: dict[str, Sequence] | None = None, missing: str = "raise", most: int = 1 << 24
) -> DataFrame:
    """Rows of the loop dimensions, the outputs' core dimensions and the outputs (doubles; NaN is NULL).

    dims: all dimensions of df. labels: of core dimensions that only outputs have, or whose labels the outputs change. An input must not vary along
    core dimensions that are not its own. missing: what a cell without a row does: raise, or nan. A null is NaN. Two rows for a cell raise, as do
    results of another shape than their labels', and boxes of more than `most` cells, since one task holds a box.
    """
    sig = parse(signature)
    if missing not in ("raise", "nan"):
        raise ValueError(f"missing {missing!r}")
    if len(sig.inputs) != len(inputs) or len(sig.outputs) != len(outputs):
        raise ValueError(f"{signature} does not fit {len(inputs)} inputs and {len(outputs)} outputs")
    if lost := [d for d in sig.core if d not in dims]:
        raise ValueError(f"{lost} are no dimensions of the cube")
    if len({frozenset(o) for o in sig.outputs}) > 1:
        raise ValueError("outputs must have the same core dimensions; apply the function once for each")
    core, loop = sig.core, [d for d in dims if d not in sig.core]
    axes = {d: _axis(df, d) for d in core}
    shape = [len(axes[d]) for d in core]
    if int(np.prod(shape)) > most:
        raise ValueError(f"a box of {shape} cells is beyond {most}")
    made = sig.outputs[0]
    given = {d: list((labels or {}).get(d, axes.get(d, []))) for d in made}
    if empty := [d for d in made if not given[d] and d not in axes]:
        raise ValueError(f"the labels of {empty} are not known")
    kind = lambda x: T.DoubleType() if isinstance(x, float) else T.LongType() if isinstance(x, int) else T.StringType() if isinstance(x, str) else T.TimestampNTZType()
    fields = [df.schema[d] for d in loop] + [df.schema[d] if d in axes and d not in (labels or {}) else T.StructField(d, kind(given[d][0])) for d in made]
    schema = T.StructType(fields + [T.StructField(o, T.DoubleType()) for o in outputs])
    sizes = [len(given[d]) for d in made]

    def positions(column: pa.ChunkedArray, dim: str) -> np.ndarray:
        return pc.index_in(column, value_set=pa.array(axes[dim], column.type)).to_numpy()

    def one(table: pa.Table) -> pa.Table:
        where = tuple(positions(table.column(d), d) for d in core)
        flat = np.ravel_multi_index(where, shape) if core else np.zeros(table.num_rows, int)
        if len(np.unique(flat)) != len(flat):
            raise ValueError("two rows have the labels of one cell")
        if missing == "raise" and len(flat) != int(np.prod(shape)):
            raise ValueError(f"{int(np.prod(shape)) - len(flat)} cells of a box have no row")
        arrays = []
        for name, own in zip(inputs, sig.inputs, strict=True):
            box = np.full(int(np.prod(shape)), np.nan)
            box[flat] = table.column(name).cast(pa.float64()).to_numpy()
            box = box.reshape(shape)
            for k in reversed([k for k, d in enumerate(core) if d not in own]):
                first = np.take(box, [0], k)
                if not np.array_equal(np.broadcast_to(first, box.shape), box, equal_nan=True):
                    raise ValueError(f"{name} varies along {core[k]}")
                box = first.squeeze(k)
            left = [d for d in core if d in own]
            arrays.append(box.transpose([left.index(d) for d in own]))
        results = function(*arrays)
        results = results if isinstance(results, tuple) else (results,)
        columns = {}
        for name, own, result in zip(outputs, sig.outputs, results, strict=True):
            result = np.asarray(result, float)
            if result.shape != tuple(len(given[d]) for d in own):
                raise ValueError(f"{name} has the shape {result.shape}, its labels {tuple(len(given[d]) for d in own)}")
            x = result.transpose([own.index(d) for d in made]).ravel()
            columns[name] = pa.array(x, mask=np.isnan(x))
        n = int(np.prod(sizes))
        at = dict(zip(made, np.unravel_index(np.arange(n), sizes), strict=True)) if made else {}
        keys = {d: table.column(d).combine_chunks().take(pa.array(np.zeros(n, int))) for d in loop}
        new = {d: pa.array([given[d][k] for k in at[d]]) for d in made}
        return pa.table(keys | new | columns)

    rows = df.select(*loop, *core, *dict.fromkeys(inputs))
    return rows.groupBy(*loop).applyInArrow(one, schema)

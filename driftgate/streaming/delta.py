"""Adaptive threshold whose state carries over between micro-batches."""

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from driftgate.operators.evaluation import STEP_ORDER, next_delta

DIRECTIONS = ("fwd", "rev")
STATE = "delta double, next long, early array<struct<position: long, sigma: double>>"


def adaptive_delta_stream(sigmas: DataFrame, run="run", first_step=0) -> DataFrame:
    """The streaming form of `adaptive_delta`: (run, step, direction, sigma, delta).

    A run's updates are applied in their order, forward before backward, whatever order they arrive in. Steps
    follow one another without a gap from `first_step`, so the state knows which update comes next: one that
    is early waits in the state, as two numbers, until those before it are there, and comes out with them. An
    update that was applied already, or a direction that is neither, raises. State is one double and one
    position per run, and what waits; updates behind one that never comes wait on.
    """
    schema = T.StructType([sigmas.schema[c] for c in (run, *STEP_ORDER, "sigma")]
                          + [T.StructField("delta", T.DoubleType())])

    def update(key, frames, state):
        delta, position, early = state.get if state.exists else (None, 2 * first_step, [])
        waiting = {p: s for p, s in early or []}
        for frame in frames:
            for step, direction, sigma in zip(frame["step"], frame["direction"], frame["sigma"]):
                if direction not in DIRECTIONS:
                    raise ValueError(f"run {key[0]}: {direction!r} is no direction")
                at = 2 * int(step) + DIRECTIONS.index(direction)
                if at < position or at in waiting:
                    raise ValueError(f"run {key[0]}: step {step} {direction} comes late or twice; "
                                     f"the next is step {position // 2} {DIRECTIONS[position % 2]}")
                waiting[at] = None if sigma is None else float(sigma)
        rows = []
        while position in waiting:
            sigma = waiting.pop(position)
            delta = next_delta(delta, sigma)
            rows.append((key[0], position // 2, DIRECTIONS[position % 2], sigma, delta))
            position += 1
        state.update((delta, position, sorted(waiting.items())))
        yield pd.DataFrame(rows, columns=schema.names)

    return sigmas.select(run, *STEP_ORDER, "sigma").groupBy(run).applyInPandasWithState(
        update, schema, STATE, "append", GroupStateTimeout.NoTimeout)

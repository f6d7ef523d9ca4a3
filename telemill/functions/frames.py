"""pandas frames to hand back to Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd


def frame(columns: dict) -> pd.DataFrame:
    """A frame whose text and nested columns are plain object arrays; scalars repeat to the longest column."""
    size = max((len(v) for v in columns.values() if isinstance(v, (list, np.ndarray))), default=0)
    out = {}
    for name, v in columns.items():
        if isinstance(v, np.ndarray) and v.dtype.kind in "biuf":
            out[name] = v
            continue
        values = v if isinstance(v, (list, np.ndarray)) else [v] * size
        kinds = {type(x) for x in values}
        if kinds and kinds <= {bool, int, float, np.int64, np.float64, np.bool_}:
            out[name] = np.asarray(values)
        else:
            a = np.empty(len(values), dtype=object)
            a[:] = list(values)
            out[name] = pd.Series(a, dtype=object)
    return pd.DataFrame(out)

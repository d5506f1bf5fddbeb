"""Order-insensitive comparison of two result frames, column by column name."""

from __future__ import annotations

import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(str(_plain(x)) for x in v) + "]"
    if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT or v is pd.NA:
        return "<null>"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return repr(float(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v) + 0.0)
    return str(v)


def normal(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_plain(v) for v in row) for row in df[cols].itertuples(index=False))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if ("O" in k or "f" in k or "b" in k) and k[0] != k[1] and len(got)}
    a, b = normal(got), normal(want)
    if a == b:
        return "" if not odd else f"(types {odd})"
    sa, sb = set(a), set(b)
    extra, missing = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    return f"rows {len(a)} vs {len(b)}; cols {sorted(got.columns)}; only spark {extra}; only sql {missing}"

"""Comparison of a query's rows with those of its SQL."""

import numpy as np
import pandas as pd


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6g}"
    return str(v)


def rows(df: pd.DataFrame):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))

"""Compare a query's rows with its SQL's."""

import math

import numpy as np


def rows_of(names, rows):
    """Sorted rows with columns by name, doubles to six places."""

    def clean(v):
        if v is None or v is np.nan or (isinstance(v, float | np.floating) and math.isnan(v)):
            return None
        if isinstance(v, float | np.floating):
            return round(float(v), 6) + 0.0
        return v.item() if isinstance(v, np.generic) else v

    columns = sorted(names)
    cells = [[clean(row[names.index(c)]) for c in columns] for row in rows]
    return columns, sorted(map(tuple, cells), key=lambda r: tuple((v is None, str(v)) for v in r))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con

SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Sorted columns, and rows as sorted tuples with rounded floats."""
    cols = sorted(df.columns)
    return cols, sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=repr)

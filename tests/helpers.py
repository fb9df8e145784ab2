import datetime as dt


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def frame(spark, ddl, rows):
    """Rows of dicts; missing columns are null."""
    names = [part.split()[0] for part in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def by(df, *keys):
    """Collected rows as dicts, keyed by one or more columns."""
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        out[k if len(keys) > 1 else k[0]] = r.asDict()
    return out

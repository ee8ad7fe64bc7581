import datetime

import numpy as np


def plain(v):
    """A value in a form in which both engines' results compare."""
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    cols = sorted(names)
    place = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in place) for r in result.fetchall()), key=str)

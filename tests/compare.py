"""Rows of a frame and of a SQL result, in one notation."""

import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=repr)


def of_sql(duck, text):
    cur = duck.execute(text)
    names = [d[0] for d in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)

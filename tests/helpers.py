import datetime as dt
import decimal
import math


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def project(df, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def expect(rows):
    return sorted((tuple(norm(x) for x in (r if isinstance(r, tuple) else (r,))) for r in rows), key=repr)


def d(text):
    """'02-JAN-11' → '2011-01-02'."""
    return dt.datetime.strptime(text.title(), "%d-%b-%y").date().isoformat()

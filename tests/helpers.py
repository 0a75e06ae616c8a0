"""What several tests use."""

import math

NAN = float("nan")


def rows(df, *cols):
    """Rows as sorted tuples, floats to 6 digits."""
    out = []
    for r in df.select(*cols).collect() if cols else df.collect():
        out.append(tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r))
    return sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in t))


def near(got, want, eps=1e-6):
    """Whether two dicts agree."""
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) <= eps * max(1, abs(want[k])) for k in want)

"""Row-set comparison of a Spark result and a DuckDB result."""


def norm(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return v


def frame(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = [tuple(norm(r[i]) for i in order) for r in rows]
    data.sort(key=repr)
    return [cols[i] for i in order], data


def kinds(row):
    return [type(v).__name__ for v in row]


def compare(got, want):
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or [k for k, v in zip(kinds(a), a) if v is not None] != [k for k, v in zip(kinds(b), b) if v is not None]:
            return f"values\n   spark {a}\n   sql   {b}"
    return None

"""Physical plans as text."""


def plan_of(df) -> str:
    """Physical plan after execution, without the plans that adaptive execution started from."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and indent >= skip:
            continue
        skip = indent if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)

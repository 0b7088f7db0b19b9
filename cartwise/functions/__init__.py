from cartwise.functions.expr import (  # noqa: F401
    cosine,
    dot,
    exact_avg,
    exact_sum,
    l2norm,
    minmax,
    pct_change,
    round2,
    unit_hash,
)

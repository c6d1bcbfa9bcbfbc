"""Small builders for segment arrays."""

from corpusloom.schema import SEGMENTS_DDL

KIND = {"s": "system", "u": "user", "a": "assistant", "t": "text"}


def segs(*turns):
    """('u', 'text') pairs → rows of a segment array."""
    return [(KIND.get(r, r), c, None) for r, c in turns]


def frame(spark, rows, extra="id string"):
    """Rows (id, segments) as a DataFrame."""
    return spark.createDataFrame(rows, f"{extra}, segments {SEGMENTS_DDL}")


def shape(window):
    """'role:content' with a star behind what trains."""
    return [f"{s['role'][0]}:{s['content']}{'*' if s['train'] else ''}" for s in window]

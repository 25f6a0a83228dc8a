"""Reports for people: small result tables as HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def to_html(df: DataFrame, title: str = "", digits: int = 2) -> str:
    """A table of at most MOST_ROWS rows; numbers rounded, nulls empty."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    show = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else html.escape(str(x))
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{show(c)}</{tag}>" for c in cells) + "</tr>"
    return f"<table><caption>{html.escape(title)}</caption>\n" + "\n".join([line(df.columns, "th"), *(line(r, "td") for r in rows)]) + "\n</table>\n"

"""Text and HTML of the first rows of a frame."""

from __future__ import annotations

import html
import pprint
from collections.abc import Sequence

HTML_ROWS = 20


def text(name: str, rows: int, columns: Sequence[str], dtypes: dict[str, str], values: Sequence[Sequence[object]], indent: int = 1, width: int = 80, depth: int | None = None, compact: bool = False) -> str:
    shown = {c: list(v) for c, v in zip(columns, values, strict=True)}
    body = pprint.pformat({"data": shown, "dtypes": dtypes, "rows": rows}, indent=indent, width=width, depth=depth, compact=compact, sort_dicts=False)
    return f"{name}({body})"


def table(columns: Sequence[str], dtypes: dict[str, str], records: Sequence[Sequence[object]]) -> str:
    """Head with a row of dtypes, and the records; all text is escaped."""
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    line = lambda tag, xs: "<tr>" + "".join(cell(tag, x) for x in xs) + "</tr>"
    head = line("th", ["", *columns]) + line("th", ["dtype", *(dtypes[c] for c in columns)])
    body = "".join(line("td", [i, *r]) for i, r in enumerate(records))
    return f"<table><thead>{head}</thead><tbody>{body}</tbody></table>"

"""Tables cut into parts within a token budget: whole rows with the header repeated, and cells of rows that fit nowhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.structure import count_tokens, split_first

#: Fixed value: how often the number of parts, which each part names, is tried.
ROUNDS = 8


def _row(cells: Sequence[str | None]) -> str:
    escape = lambda c: (c or "").replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "\n").replace("\r", "\n").replace("\n", "<br>")
    return f"| {' | '.join(map(escape, cells))} |"


def _part(k: int, n: int, body: str) -> str:
    return f"[TABLE PART {k}/{n}]\n{body}\n[TABLE PART]"


def split_table(rows: Sequence[Sequence[str | None]], n_header: int, fits: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    """(content, first row, last row), rows counted from 0; a ValueError if a cell fits nowhere. A header that doesn't fit is a row like others."""
    lines = [_row(r) for r in rows]
    if not lines:
        return []
    if fits(whole := "\n".join(["[TABLE]", *lines, "[/TABLE]"])):
        return [(whole, 0, len(lines) - 1)]
    if n_header and not fits(_part(1, 1, "\n".join(lines[:n_header]))):
        n_header = 0
    head = lines[:n_header]

    def content(k: int, n: int, a: int, b: int) -> str:
        again = ["[REPEATED HEADER]", *head, "[/REPEATED HEADER]"] if head and k > 1 else []
        return _part(k, n, "\n".join([*again, *(head if k == 1 else []), *lines[a:b]]))

    def most(k: int, n: int, a: int) -> int:
        """The greatest end of rows from `a` that fit: steps that double, then halving."""
        ok, step = a, 1
        while ok < len(lines) and fits(content(k, n, a, min(ok + step, len(lines)))):
            ok, step = min(ok + step, len(lines)), step * 2
        bad = min(ok + step, len(lines) + 1)
        while bad - ok > 1:
            mid = (ok + bad) // 2
            ok, bad = (mid, bad) if mid <= len(lines) and fits(content(k, n, a, mid)) else (ok, mid)
        return ok

    def cells(r: int, k: int, n: int) -> Iterator[str]:
        for c, text in enumerate(rows[r], 1):
            tag = lambda t, c=c: f"[TABLE ROW {r + 1} PART]\n[COLUMN {c}]\n{t}\n[/COLUMN]\n[/TABLE ROW PART]"
            rest = text or ""
            if not rest.strip():
                yield tag("")
            while rest.strip():
                piece, rest = split_first(rest, lambda t: fits(_part(k, n, tag(t))))
                if not piece.strip():
                    raise ValueError("a table cell doesn't fit")
                yield tag(piece)

    def layout(n: int) -> list[tuple[str | None, int, int]]:
        out, at = [], n_header
        while at < len(lines):
            k = len(out) + 1
            end = most(k, max(n, k), at)
            if end > at or (head and not out):
                out.append((None, at, end))
            else:
                out += [(body, at, at + 1) for body in cells(at, k, max(n, k))]
                end = at + 1
            at = end
        return out or [(None, n_header, n_header)]

    n, parts = 1, layout(1)
    for _ in range(ROUNDS - 1):
        if len(parts) == n:
            break
        n, parts = len(parts), layout(len(parts))
    n = len(parts)
    return [(_part(k, n, raw) if raw is not None else content(k, n, a, b), 0 if k == 1 else a, max(b - 1, a if raw is not None else 0)) for k, (raw, a, b) in enumerate(parts, 1)]


def table_parts(tables: DataFrame, max_tokens: int = 1200, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """(doc, table, part, content, first_page, last_page, error) from tables (doc, table, rows, pages of the rows, n_header).

    A table at a time, in place. A table with a cell that fits nowhere gives one row with its error and no content; null or no rows give none."""
    kinds = {c: tables.schema[c].dataType.simpleString() for c in ("doc", "table")}
    schema = f"doc {kinds['doc']}, table {kinds['table']}, part int, content string, first_page int, last_page int, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, table, rows, pages, n in f.itertuples(index=False):
                try:
                    found = split_table([] if rows is None else [list(r) for r in rows], 0 if pd.isna(n) else int(n), lambda t: tokens(t) <= max_tokens)
                    out += [(doc, table, k, text, int(pages[a]), int(pages[b]), None) for k, (text, a, b) in enumerate(found, 1)]
                except ValueError as e:
                    out.append((doc, table, 1, None, None, None, str(e)))
            made = pd.DataFrame(out, columns=["doc", "table", "part", "content", "first_page", "last_page", "error"])
            yield made.astype({c: "Int32" for c in ("part", "first_page", "last_page")})

    return tables.select("doc", "table", "rows", "pages", "n_header").mapInPandas(run, schema)

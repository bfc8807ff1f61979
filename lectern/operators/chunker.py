"""Chunks of whole documents: headings, texts and tables packed in order up to a token budget, one section path a chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.structure import TOO_SMALL, count_tokens, split_first
from lectern.operators.table_parts import split_table

Path = tuple[tuple[int, str], ...]


def markdown(path: Path) -> str:
    return "\n".join(f"{'#' * min(level, 6)} {text}" for level, text in path)


class Packer:
    """The open chunk of one document: its path, its bodies and the pages they are on."""

    def __init__(self, fits: Callable[[str], bool]):
        self.fits = fits
        self.out: list[tuple[Path, str, int, int, str | None]] = []
        self.path: Path = ()
        self.bodies: list[str] = []
        self.first = self.last = 0
        self.pending: tuple[Path, int] | None = None

    def content(self, path: Path, bodies: Sequence[str]) -> str:
        return "\n\n".join([*([markdown(path)] if path else []), *bodies])

    def flush(self) -> None:
        if self.bodies:
            self.out.append((self.path, self.content(self.path, self.bodies), self.first, self.last, None))
        self.bodies = []

    def settle(self, path: Path) -> None:
        """A heading waits for a body under it; without one it is a chunk of its own."""
        if self.pending is not None and path[: len(self.pending[0])] != self.pending[0]:
            heads, page = self.pending
            text = self.content(heads, [])
            self.out.append((heads, text, page, page, None if self.fits(text) else TOO_SMALL))
        self.pending = None

    def put(self, path: Path, body: str, first: int, last: int) -> None:
        if not self.bodies:
            self.path, self.first, self.last = path, first, last
        self.bodies.append(body)
        self.first, self.last = min(self.first, first), max(self.last, last)

    def refuse(self, path: Path, body: str, first: int, last: int, why: str) -> None:
        self.out.append((path, body, first, last, why))

    def heading(self, path: Path, page: int) -> None:
        self.flush()
        self.settle(path)
        self.pending = path, page

    def text(self, path: Path, text: str, first: int, last: int) -> None:
        self.settle(path)
        if path != self.path:
            self.flush()
        rest = text
        while rest.strip():
            held = self.bodies
            part, left = split_first(rest, lambda t: self.fits(self.content(path, [*held, t.strip()])))
            if not part.strip():
                if not held:
                    self.refuse(path, rest, first, last, TOO_SMALL)
                    return
                self.flush()
                continue
            self.put(path, part.strip(), first, last)
            rest = left
            if rest.strip():
                self.flush()

    def table(self, path: Path, rows: Sequence[Sequence[str]], n_header: int, first: int, last: int) -> None:
        self.settle(path)
        try:
            parts = split_table(rows, n_header, lambda t: self.fits(self.content(path, [t])))
        except ValueError as e:
            self.flush()
            self.refuse(path, "", first, last, str(e))
            return
        if len(parts) == 1:
            if path != self.path or not self.fits(self.content(path, [*self.bodies, parts[0][0]])):
                self.flush()
            self.put(path, parts[0][0], first, last)
            return
        self.flush()
        for body, _, _ in parts:
            self.put(path, body, first, last)
            self.flush()

    def end(self) -> list[tuple[Path, str, int, int, str | None]]:
        self.flush()
        if self.pending is not None:
            heads, page = self.pending
            text = self.content(heads, [])
            self.out.append((heads, text, page, page, None if self.fits(text) else TOO_SMALL))
            self.pending = None
        return self.out


def pack_documents(blocks: DataFrame, max_tokens: int = 1200, tokens: Callable[[str], int] = count_tokens) -> DataFrame:
    """(doc, chunk_no, path, content, tokens, first_page, last_page, error) of blocks (doc, ord, kind, path, text, rows, n_header, first_page, last_page).

    kind: `heading` (its path ends with itself), `text` or `table`. path: array of (level, text). A chunk is its path as headings and the
    bodies under it. A heading without a body under it is a chunk of its own. A text goes in as far as it fits and on in the next chunk; a
    table goes in whole if it fits alone, else each of its parts is a chunk. What fits nowhere is a row with `error` and without chunk_no.
    Null paths are the root. A document is packed in one task, in the order of ord."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(lambda t: tokens(t) <= max_tokens)
        doc = frame["doc"].iloc[0]
        for b in frame.sort_values("ord").itertuples(index=False):
            path = tuple((h["level"], h["text"]) for h in (b.path if b.path is not None else ()))
            first, last = (0 if pd.isna(x) else int(x) for x in (b.first_page, b.last_page))
            if b.kind == "heading":
                packer.heading(path, first)
            elif b.kind == "table":
                packer.table(path, [list(r) for r in b.rows] if b.rows is not None else [], 0 if pd.isna(b.n_header) else int(b.n_header), first, last)
            elif isinstance(b.text, str):
                packer.text(path, b.text, first, last)
        out, number = [], 0
        for path, content, first, last, why in packer.end():
            number += why is None
            out.append((doc, number if why is None else None, [{"level": lvl, "text": t} for lvl, t in path], content, tokens(content), first, last, why))
        made = pd.DataFrame(out, columns=["doc", "chunk_no", "path", "content", "tokens", "first_page", "last_page", "error"])
        return made.astype({"chunk_no": "Int64"})

    fields = ["doc", "ord", "kind", "path", "text", "rows", "n_header", "first_page", "last_page"]
    return blocks.select(*fields).groupBy("doc").applyInPandas(pack, "doc string, chunk_no long, path array<struct<level:int,text:string>>, content string, tokens long, first_page int, last_page int, error string")

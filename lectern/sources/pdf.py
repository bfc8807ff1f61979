"""Text of PDF files page by page, by any reader; the default one reads the text layer of plain files with the standard library.

The default reader takes the objects of a file as they stand, also those in object streams, undoes FlateDecode, follows the tree of pages
and shows the strings of their content streams: a new line for each move to another line. It knows single-byte fonts in WinAnsi or
Latin-1 only, no images, no encryption. Give a reader of your own for anything else; a table reader gives (top, left, bottom, right, rows)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PARSE_ERROR = "PDF_PARSE_ERROR"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_CHARACTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}


def _plain(body: bytes) -> bytes | None:
    """The content of an object's stream; null if it has none or one that isn't FlateDecode."""
    found = _STREAM.search(body)
    if not found:
        return None
    head = body[: found.start()]
    if b"/Filter" not in head:
        return found.group(1)
    return zlib.decompressobj().decompress(found.group(1)) if b"/FlateDecode" in head else None


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body and (plain := _plain(body)) is not None:
            first, n = (int(re.search(rb"/" + name + rb"\s+(\d+)", body).group(1)) for name in (b"First", b"N"))
            numbers = [int(x) for x in plain[:first].split()[: 2 * n]]
            places = [*numbers[1::2], len(plain) - first]
            for k, number in enumerate(numbers[::2]):
                out.setdefault(number, plain[first + places[k] : first + places[k + 1]])
    return out


def _pages(objects: dict[int, bytes]) -> Iterator[bytes]:
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if root is None:
        raise ValueError("no catalog of pages")
    todo, seen = [int(re.search(rb"/Pages\s+(\d+)", root).group(1))], set()
    while todo:
        number = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            todo += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1))][::-1]
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPED.sub(lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() and m.group(1)[:1] < b"8" else _CHARACTERS.get(m.group(1), m.group(1)), token[1:-1])
    return raw.decode("cp1252", "replace")


def shown_text(content: bytes) -> str:
    """The strings that a content stream shows, a line feed for each move to another line, a blank for a wide gap within an array."""
    out: list[str] = []
    held: list[bytes] = []

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in _SHOWN.finditer(content):
        token = m.group(0)
        if token[:1] in b"(<[]-.0123456789":
            held.append(token)
            continue
        if token in (b"'", b'"', b"T*", b"ET"):
            line()
        elif token in (b"Td", b"TD") and held and float(held[-1] or 0) != 0:
            line()
        elif token == b"Tm":
            line()
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for x in held:
                if x[:1] in b"(<":
                    out.append(_string(x))
                elif token == b"TJ" and x[:1] == b"-" and float(x) < -200:
                    out.append(" ")
        held = []
    return "".join(out).strip("\n")


def text_layer(data: bytes) -> list[str]:
    """The text of each page in order."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    objects = _objects(data)
    out = []
    for page in _pages(objects):
        at = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        parts = [_plain(objects.get(int(x), b"")) or b"" for x in re.findall(rb"(\d+)\s+\d+\s+R", at.group(1))] if at else []
        out.append(shown_text(b"\n".join(parts)))
    return out


def _each(files: DataFrame, reader: Callable[[bytes], Iterable], schema: str, columns: list[str], rows: Callable) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    made = [(path, *r, None) for r in rows(reader(bytes(content) if content is not None else b""))]
                except Exception as e:  # noqa: BLE001  the error is the file's result
                    made = [(path, *(None for _ in columns), f"{PARSE_ERROR}: {type(e).__name__}: {e}")]
                yield pd.DataFrame(made, columns=["path", *columns, "error"])

    return files.select("path", "content").mapInPandas(run, schema)


def read_pages(files: DataFrame, reader: Callable[[bytes], Iterable[str]] = text_layer) -> DataFrame:
    """(path, page, text, error) of files (path, content): pages from 1; a file that can't be read is one row with its error."""
    return _each(files, reader, "path string, page long, text string, error string", ["page", "text"], lambda pages: enumerate(pages, 1)).selectExpr("path", "cast(page as int) as page", "text", "error")


def read_tables(files: DataFrame, reader: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(path, page, ruled, top, left, bottom, right, rows, error): the tables that a reader finds, (page, ruled, top, left, bottom, right, rows)
    each. On a page with ruled tables those laid out by white space only are left out."""
    schema = "path string, page long, ruled boolean, top double, left double, bottom double, right double, rows array<array<string>>, error string"

    def rows(found: Iterable[tuple]) -> list[tuple]:
        found = list(found)
        ruled = {t[0] for t in found if t[1]}
        return [t for t in found if t[1] or t[0] not in ruled]

    return _each(files, reader, schema, ["page", "ruled", "top", "left", "bottom", "right", "rows"], rows).selectExpr("path", "cast(page as int) as page", "ruled", "top", "left", "bottom", "right", "rows", "error")

"""Plans as DOCX files: one table of six columns, written as OOXML with the standard library; and as multipart bodies.

Input is (plan, json) with the JSON of a normalized plan. Results are columns of bytes, so that a plan is made again alike after a lost
task; write_files puts them into a folder of any file system that pyarrow reaches."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

#: The layout of the document, its title and headings.
FONT, PAGE, MARGINS = "Times New Roman", (12240, 15840), (1440, 1800)
WIDTHS = [480, 1650, 3300, 1050, 750, 1410]
CELL_MARGINS = {"top": 70, "left": 100, "bottom": 70, "right": 100}
TITLE = "Перечень услуг по техническому обслуживанию медицинского изделия: "
HEADINGS = ["№ п.п.", "Наименование МИ", "Перечень выполняемых работ", "Регистрационный номер медицинского изделия", "Инвентарный номер", "Периодичность технического обслуживания"]
MERGED = (1, 3, 4)
MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{MIME}.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def _p(text: str, align: str = "left", size: int = 8, bold: bool = False) -> str:
    text = "".join(c for c in text if c >= " " or c in "\t\n")
    return f'<w:p><w:pPr><w:spacing w:before="0" w:after="0" w:line="240"/><w:jc w:val="{align}"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:cs="{FONT}"/>{"<w:b/>" * bold}<w:sz w:val="{2 * size}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _cell(column: int, *paragraphs: str, merge: str = "", center: bool = True) -> str:
    margins = "".join(f'<w:{side} w:w="{w}" w:type="dxa"/>' for side, w in CELL_MARGINS.items())
    merged = f'<w:vMerge w:val="{merge}"/>' if merge else ""
    return f'<w:tc><w:tcPr><w:tcW w:w="{WIDTHS[column]}" w:type="dxa"/>{merged}<w:tcMar>{margins}</w:tcMar>{"<w:vAlign w:val=\"center\"/>" * center}</w:tcPr>{"".join(paragraphs)}</w:tc>'


def _text(value) -> str:
    return "" if value is None else str(value)


def docx(plan: dict) -> bytes:
    """The plan's document; a ValueError if no row names a device. Equal plans give equal bytes."""
    rows = [r for s in plan["sections"] for r in s["rows"]]
    device = next((_text(r.get("deviceName")).strip() for r in rows if _text(r.get("deviceName")).strip()), None)
    if device is None:
        raise ValueError("the plan names no device")
    registered = next((r for r in rows if _text(r.get("registrationNumber")).strip()), {})
    notice = _text(registered.get("registrationNumberExpiryNotice"))
    number = [_p(_text(registered.get("registrationNumber")).strip(), "center")] + [_p(notice, "center", 7)] * bool(notice.strip())
    lines = ["<w:tr><w:trPr><w:tblHeader/></w:trPr>" + "".join(_cell(c, _p(h, "center", 8, True)) for c, h in enumerate(HEADINGS)) + "</w:tr>"]
    for k, r in enumerate(rows):
        work = [_p(_text(r.get("maintenanceType")), bold=True), *(_p(f"— {_text(step)}") for step in r.get("maintenanceWorkDescription") or [])]
        held = [[_p(_text(r.get("number")), "center")], [_p(device)], work, number, [_p("", "center")], [_p(_text(r.get("frequency")), "center")]]
        lines.append("<w:tr>" + "".join(_cell(c, *ps, merge=("continue" if k else "restart") if c in MERGED else "", center=c != 2) for c, ps in enumerate(held)) + "</w:tr>")
    borders = "".join(f'<w:{side} w:val="single" w:sz="4" w:color="000000"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in WIDTHS)
    table = f'<w:tbl><w:tblPr><w:tblW w:w="{sum(WIDTHS)}" w:type="dxa"/><w:tblBorders>{borders}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(lines)}</w:tbl>'
    section = f'<w:sectPr><w:pgSz w:w="{PAGE[0]}" w:h="{PAGE[1]}"/><w:pgMar w:top="{MARGINS[0]}" w:right="{MARGINS[1]}" w:bottom="{MARGINS[0]}" w:left="{MARGINS[1]}" w:header="0" w:footer="0" w:gutter="0"/></w:sectPr>'
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{_p(TITLE + device, "center", 10, True)}{table}{_p("")}{section}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode())
    return out.getvalue()


def multipart(plan: dict, document: bytes, boundary: str) -> bytes:
    """A body of three parts: the document, the plan and its consumables."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()
    kind = "application/json; charset=UTF-8"
    parts = [(MIME, 'attachment; name="document"; filename="maintenance-plan.docx"', document), (kind, 'inline; name="plan"', dump(plan)), (kind, 'inline; name="consumables"', dump(plan.get("consumables", [])))]
    body = b"".join(f"--{boundary}\r\nContent-Type: {t}\r\nContent-Disposition: {d}\r\n\r\n".encode() + data + b"\r\n" for t, d, data in parts)
    return body + f"--{boundary}--\r\n".encode()


def _made(plans: DataFrame, plan: str, json_col: str, columns: tuple[str, ...], make) -> DataFrame:
    """A column for each of what `make` gives for a plan's text and its JSON, and `error` in place of these."""
    kind = plans.schema[plan].dataType.simpleString()

    def one(text: str | None) -> tuple:
        try:
            return *make(text, json.loads(text)), None
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            return *(None for _ in columns), f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f[json_col]]
            yield pd.DataFrame({plan: f[plan], **{c: [g[k] for g in got] for k, c in enumerate((*columns, "error"))}})

    return plans.select(plan, json_col).mapInPandas(run, f"{plan} {kind}, " + "".join(f"{c} binary, " for c in columns) + "error string")


def render_documents(plans: DataFrame, plan: str = "plan", json_col: str = "json") -> DataFrame:
    """(plan, docx, error): as render_plans, without the multipart bodies."""
    return _made(plans, plan, json_col, ("docx",), lambda _, parsed: (docx(parsed),))


def read_texts(documents: DataFrame, column: str = "docx") -> DataFrame:
    """Replace a column of DOCX bytes by `paragraphs`, the texts of their paragraphs in order; null bytes have null."""
    names = [c for c in documents.columns if c not in (column, "paragraphs")]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names) + ", paragraphs array<string>"

    def texts(data: bytes | None) -> list[str] | None:
        import xml.etree.ElementTree as tree

        if data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = tree.fromstring(z.read("word/document.xml"))
        return ["".join(t.text or "" for t in p.iter(f"{{{_W}}}t")) for p in root.iter(f"{{{_W}}}p")][:-1]  # the last one closes the table

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[names].assign(paragraphs=[texts(bytes(d) if d is not None else None) for d in f[column]])

    return documents.select(*names, column).mapInPandas(run, schema)


def render_plans(plans: DataFrame, plan: str = "plan", json_col: str = "json") -> DataFrame:
    """(plan, docx, multipart, error). The boundary follows from the plan's text; null, other JSON and plans without a device have an error and no bytes."""

    def make(text: str, parsed: dict) -> tuple[bytes, bytes]:
        made = docx(parsed)
        return made, multipart(parsed, made, f"plan-{uuid.uuid5(uuid.NAMESPACE_OID, text).hex}")

    return _made(plans, plan, json_col, ("docx", "multipart"), make)


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(name, bytes) of the files written, once an action runs; each is written beside its place and then moved there, so a task can run again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for f in frames:
            for n, data in zip(f[name], f[content]):
                part = f"{root}/.{n}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{root}/{n}")
            yield pd.DataFrame({"name": f[name], "bytes": [len(d) for d in f[content]]})

    return files.where(f"{name} is not null and {content} is not null").select(name, content).mapInPandas(run, "name string, bytes long")

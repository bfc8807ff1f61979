import zlib

from lectern.sources import pdf


def made(texts, packed=True):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(texts))) + b"] /Count %d >>" % len(texts)]
    for k, t in enumerate(texts):
        content = zlib.compress(t) if packed else t
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * k))
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(content), b" /Filter /FlateDecode" if packed else b"") + content + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [rb"BT /F1 12 Tf 72 700 Td (First \(line\)) Tj 0 -14 Td [(sec) -10 (ond) -300 (line)] TJ T* <C4> Tj ET", b"BT (Next page) Tj ET"]


def test_text_layer():
    for packed in (True, False):
        assert pdf.text_layer(made(PAGES, packed)) == ["First (line)\nsecond line\nÄ", "Next page"]
    assert pdf.shown_text(rb"BT (a\101\
b\n) Tj ET") == "aAb"


def test_read_pages(spark):
    files = spark.createDataFrame([("a", bytearray(made(PAGES))), ("b", bytearray(b"no pdf")), ("c", None)], "path string, content binary")
    rows = pdf.read_pages(files).collect()
    assert [(r.page, r.text) for r in rows if r.path == "a"] == [(1, "First (line)\nsecond line\nÄ"), (2, "Next page")]
    assert all(r.error.startswith("PDF_PARSE_ERROR") and r.page is None for r in rows if r.path != "a")
    other = pdf.read_pages(files.where("path = 'b'"), lambda data: [data.decode().upper()]).first()
    assert (other.page, other.text, other.error) == (1, "NO PDF", None)


def test_read_tables(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    found = [(1, True, 1.0, 1.0, 2.0, 2.0, [["r"]]), (1, False, 5.0, 1.0, 6.0, 2.0, [["s"]]), (2, False, 1.0, 1.0, 2.0, 2.0, [["t"]])]
    rows = pdf.read_tables(files, lambda data: found).collect()
    assert [(r.page, r.ruled, r.rows) for r in rows] == [(1, True, [["r"]]), (2, False, [["t"]])]

"""Workbooks, Word files and PDF files written without further libraries, for what fits a person's screen."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

#: Rows that a sheet holds at most.
MOST_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument"


@dataclass(frozen=True)
class Style:
    """fill and colour are RRGGBB; form is a number format."""

    fill: str | None = None
    colour: str | None = None
    bold: bool = False
    form: str | None = None


@dataclass
class Sheet:
    """Rows of values, or of (value, Style); widths by column; filtered: whether the first row gets filter arrows."""

    name: str
    rows: list[list] = field(default_factory=list)
    widths: list[float] = field(default_factory=list)
    filtered: bool = False


def letters(n: int) -> str:
    """A column's name: 0 is A, 26 is AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _styles(styles: list[Style]) -> str:
    fonts = "".join(f"<font>{'<b/>' * s.bold}<sz val=\"11\"/>{f'<color rgb=\"FF{s.colour}\"/>' if s.colour else ''}<name val=\"Calibri\"/></font>" for s in styles)
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/></patternFill></fill>' if s.fill else '<fill><patternFill patternType="none"/></fill>' for s in styles)
    forms = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{escape(s.form)}"/>' for k, s in enumerate(styles) if s.form)
    n = sum(bool(s.form) for s in styles)
    cells = "".join(f'<xf numFmtId="{164 + k if s.form else 0}" fontId="{k}" fillId="{k + 2}" borderId="0" applyFont="1" applyFill="1" applyNumberFormat="1"/>' for k, s in enumerate(styles))
    gray = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    return (
        f'<styleSheet xmlns="{MAIN}">{f"""<numFmts count="{n}">{forms}</numFmts>""" if n else ""}<fonts count="{len(styles)}">{fonts}</fonts><fills count="{len(styles) + 2}">{gray}{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(styles)}">{cells}</cellXfs></styleSheet>'
    )


def workbook(sheets: list[Sheet]) -> bytes:
    """SNK1, SNK2: an .xlsx file."""
    if any(len(s.rows) > MOST_ROWS for s in sheets):
        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write several workbooks")
    number = {Style(): 0}

    def cell(v, at: str) -> str:
        v, style = v if isinstance(v, tuple) else (v, Style())
        s = number.setdefault(style, len(number))
        if v is None:
            return f'<c r="{at}" s="{s}"/>'
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}" s="{s}"><v>{v}</v></c>'
        return f'<c r="{at}" s="{s}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def sheet(s: Sheet) -> str:
        rows = "".join(f'<row r="{i}">{"".join(cell(v, f"{letters(k)}{i}") for k, v in enumerate(r))}</row>' for i, r in enumerate(s.rows, 1))
        widths = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(s.widths, 1))
        arrows = f'<autoFilter ref="A1:{letters(len(s.rows[0]) - 1)}{len(s.rows)}"/>' if s.filtered and s.rows else ""
        return f'<worksheet xmlns="{MAIN}">{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{rows}</sheetData>{arrows}</worksheet>'

    bodies = [sheet(s) for s in sheets]
    of = f"{KIND}.spreadsheetml"
    names = "".join(f'<sheet name="{escape(s.name)}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{of}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACK}/relationships">{links}<Relationship Id="styles" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _styles(list(number)),
    } | {f"xl/worksheets/sheet{k}.xml": b for k, b in enumerate(bodies, 1)}
    types += f'<Override PartName="/xl/workbook.xml" ContentType="{of}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{of}.styles+xml"/>'
    return _package(types, "xl/workbook.xml", parts)


def _package(types: str, main: str, parts: dict[str, str]) -> bytes:
    first = {
        "[Content_Types].xml": f'<Types xmlns="{PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACK}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (first | parts).items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{body}')
    return out.getvalue()


def docx(text: str) -> bytes:
    """SNK5: a Word file with a paragraph for each line."""
    words = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.splitlines())
    types = f'<Override PartName="/word/document.xml" ContentType="{KIND}.wordprocessingml.document.main+xml"/>'
    return _package(types, "word/document.xml", {"word/document.xml": f'<w:document xmlns:w="{words}"><w:body>{body}</w:body></w:document>'})


def pdf(text: str, width: int = 90, lines: int = 55) -> bytes:
    """SNK5: a PDF file with selectable text: lines of `width` characters, `lines` of them a page, in Helvetica. Characters that the standard
    encoding of its fonts lacks become question marks."""
    rows = [line[k : k + width] for line in text.splitlines() or [""] for k in range(0, max(1, len(line)), width)]
    pages = [rows[k : k + lines] for k in range(0, len(rows), lines)]
    shown = lambda x: b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        body = b"BT /F1 11 Tf 13.5 TL 50 790 Td\n" + b"\n".join(map(shown, page)) + b"\nET"
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for k, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (k, body))
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, at))
    return out.getvalue()


def exported(text: str, form: str) -> bytes:
    """SNK5: a text as txt, docx or pdf; another form, or a blank text, is an error."""
    if not text.strip():
        raise ValueError("nothing to export")
    if form not in ("txt", "docx", "pdf"):
        raise ValueError(f"unknown form: {form}")
    return text.encode() if form == "txt" else docx(text) if form == "docx" else pdf(text)

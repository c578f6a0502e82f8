"""Documents: mail, Word, PDF and Outlook files; text units out of them, and masked copies of them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.message import EmailMessage
from pathlib import Path
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ADDRESSES = ("From", "To", "Cc", "Reply-To", "Bcc")
Mask = Callable[[str], str]


def parse_mail(raw: bytes) -> EmailMessage:
    return message_from_bytes(raw, policy=policy.default)


def body_parts(mail: EmailMessage) -> Iterator[tuple[EmailMessage, str]]:
    for part in mail.walk():
        if part.get_content_type() in ("text/plain", "text/html"):
            raw = part.get_payload(decode=True)
            if raw is None:
                continue
            try:
                yield part, raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                continue


def mask_addresses(value: str, mask: Mask) -> str:
    """A list of addresses with each address masked; display names stay."""
    out = []
    for one in value.split(","):
        m = re.fullmatch(r"(\s*)(.*?)\s*<([^<>]*)>\s*", one, re.S)
        out.append(f"{m[1]}{m[2]} <{mask(m[3])}>" if m and m[2] else f"<{mask(m[3])}>" if m else mask(one))
    return ",".join(out)


def mask_mail(raw: bytes, mask: Mask) -> tuple[bytes, int]:
    """The message with addresses, subject and text parts masked; other headers and parts stay."""
    mail = parse_mail(raw)
    for h in (*ADDRESSES, "Subject"):
        if mail[h] is not None:
            old = str(mail[h])
            del mail[h]
            mail[h] = mask(old) if h == "Subject" else mask_addresses(old, mask)
    for part, text in list(body_parts(mail)):
        part.set_content(mask(text), subtype=part.get_content_subtype(), charset="utf-8")
    return mail.as_bytes(), 1


def paragraphs(root: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    """Body paragraphs, then the paragraphs of table cells."""
    body = root.find(W + "body")
    yield from (("paragraph", p) for p in body.findall(W + "p"))
    for table in body.findall(W + "tbl"):
        for cell in table.iter(W + "tc"):
            yield from (("cell", p) for p in cell.findall(W + "p"))


def text_of(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(W + "t"))


def mask_docx(raw: bytes, mask: Mask) -> tuple[bytes, int]:
    """A changed paragraph's text goes into its first run, the others are emptied; the count is of units."""
    out, n, cells = io.BytesIO(), 0, 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in z.namelist():
            data = z.read(name)
            if name == "word/document.xml":
                for prefix, (_, uri) in ((e[0], e) for _, e in ET.iterparse(io.BytesIO(data), ["start-ns"])):
                    ET.register_namespace(prefix, uri)
                root = ET.fromstring(data)
                body = root.find(W + "body")
                cells = sum(1 for t in body.findall(W + "tbl") for _ in t.iter(W + "tc"))
                for kind, p in paragraphs(root):
                    n += kind == "paragraph"
                    old = text_of(p)
                    now = mask(old) if old else old
                    if now != old:
                        for i, t in enumerate(p.iter(W + "t")):
                            t.text = "" if i else now
                            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                data = ET.tostring(root, "utf-8", xml_declaration=True)
            new.writestr(name, data)
    return out.getvalue(), n + cells


def pdf_pages(raw: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs the package pypdf") from e
    pages = []
    for page in PdfReader(io.BytesIO(raw)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # a page that cannot be read is empty
            pages.append("")
    if not pages:
        raise ValueError("the PDF has no pages")
    return pages


def mask_pdf(raw: bytes, mask: Mask) -> tuple[bytes, int]:
    """The masked text laid out anew: A4, margins of 20 mm, lines 5 mm apart and of at most 120 characters."""
    pages = [mask(p) for p in pdf_pages(raw)]
    try:
        from reportlab.lib.pagesizes import A4
        from reportlab.lib.units import mm
        from reportlab.pdfgen.canvas import Canvas
    except ImportError as e:
        raise ValueError("writing PDF needs the package reportlab") from e
    out = io.BytesIO()
    canvas = Canvas(out, pagesize=A4)
    for page in pages:
        y = A4[1] - 20 * mm
        for line in page.splitlines():
            if y < 20 * mm:
                canvas.showPage()
                y = A4[1] - 20 * mm
            canvas.drawString(20 * mm, y, line[:120])
            y -= 5 * mm
        canvas.showPage()
    canvas.save()
    return out.getvalue(), len(pages)


def msg_to_mail(raw: bytes) -> bytes:
    try:
        import extract_msg
    except ImportError as e:
        raise ValueError("reading Outlook files needs the package extract_msg") from e
    m, mail = extract_msg.openMsg(raw), EmailMessage()
    for h, v in (("From", m.sender), ("To", m.to), ("Cc", m.cc), ("Subject", m.subject), ("Date", str(m.date or ""))):
        if v:
            mail[h] = v
    mail.set_content(m.body or "")
    return mail.as_bytes()


def mask_msg(raw: bytes, mask: Mask) -> tuple[bytes, int]:
    return mask_mail(msg_to_mail(raw), mask)


MASKERS: dict[str, Callable[[bytes, Mask], tuple[bytes, int]]] = {".eml": mask_mail, ".docx": mask_docx, ".pdf": mask_pdf, ".msg": mask_msg}


def units_of(name: str, raw: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a document, by its extension; an unknown one is plain text."""
    kind = Path(name).suffix.lower()
    if kind in (".eml", ".msg"):
        mail = parse_mail(raw if kind == ".eml" else msg_to_mail(raw))
        return [(h, str(mail[h])) for h in (*ADDRESSES, "Subject") if mail[h] is not None] + [("body", t) for _, t in body_parts(mail)]
    if kind == ".docx":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [(k, text_of(p)) for k, p in paragraphs(ET.fromstring(z.read("word/document.xml")))]
    if kind == ".pdf":
        return [("page", t) for t in pdf_pages(raw)]
    return [("text", raw.decode("utf-8", "replace"))]


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, unit, kind, text) of many documents, read on the executors; mask_text() goes over `text`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = units_of(p, raw)
                yield pa.RecordBatch.from_pydict({"path": pa.array([p] * len(got), pa.string()), "unit": pa.array(range(len(got)), pa.int32()), "kind": pa.array([k for k, _ in got], pa.string()), "text": pa.array([t for _, t in got], pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, unit int, kind string, text string")


def document_text(spark: SparkSession, path: str) -> str:
    """All text of one document; what cannot be read is a ValueError."""
    if not Path(path).exists():
        raise ValueError(f"no file {path}")
    try:
        return "\n".join(t for _, t in units_of(path, Path(path).read_bytes()))
    except (KeyError, zipfile.BadZipFile, ET.ParseError) as e:
        raise ValueError(f"{path} cannot be read: {e}") from e


def mask_documents(spark: SparkSession, path: str, mask: Mask) -> DataFrame:
    """(path, content, units): masked copies of many documents, made on the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                maker = MASKERS.get(Path(p).suffix.lower())
                data, n = maker(raw, mask) if maker else (mask(raw.decode("utf-8", "replace")).encode(), 1)
                yield pa.RecordBatch.from_pydict({"path": pa.array([p]), "content": pa.array([data], pa.binary()), "units": pa.array([n], pa.int32())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, content binary, units int")


def sensitive_band(words: Column, is_sensitive: Callable[[Column], Column], height: Column, least_conf: float = 60, margin: int = 5) -> Column:
    """struct(top, bottom) of the horizontal band that holds all sensitive words of a recognised image, a margin
    around it, within the image; null if there is none. words: array of struct(text, conf, x, y, w, h)."""
    hit = F.filter(words, lambda b: (b["conf"] >= least_conf) & is_sensitive(b["text"]))
    top = F.greatest(F.array_min(F.transform(hit, lambda b: b["y"])) - margin, F.lit(0))
    bottom = F.least(F.array_max(F.transform(hit, lambda b: b["y"] + b["h"])) + margin, height)
    return F.when(F.size(hit) > 0, F.struct(top.alias("top"), bottom.alias("bottom")))

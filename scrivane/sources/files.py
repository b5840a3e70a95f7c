"""Documents as rows: bytes and a path in, text and a status out. Failures are data, never exceptions.

Text is decoded inside the JVM; Word files are opened in Arrow batches with the standard library; PDF pages and images
need optional packages and otherwise say so in their status. A PDF adapter gives blocks; their order, the choice between
them and recognised text and the joining of pages are expressions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scrivane.functions.text import clean_extracted, strip, word_count
from scrivane.sources import ocr

IMAGES = ("jpg", "jpeg", "png", "webp", "tiff", "bmp")
CORPUS = "id long, resume_str string, resume_html string, category string"
RESULT = StructType([StructField("text", StringType()), StructField("status", StringType())])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, ...) of a folder's files, one row each; a missing file is an absent row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext == "docx", "docx").when(ext.isin(*IMAGES), "image").otherwise("text")


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def paragraph_text(p) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_text(data: bytes) -> tuple[str, str]:
    """Paragraphs, then tables (cells by ' | ', rows by line), then section headers put first unless there already."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        heads = [ElementTree.fromstring(archive.read(n)) for n in sorted(archive.namelist()) if n.startswith("word/header")]
    except Exception as error:
        return "", f"error: Could not parse DOCX file — {error}"
    content = [t for t in (paragraph_text(p).strip() for p in body.findall(f"{_W}p")) if t]
    for table in body.findall(f"{_W}tbl"):
        rows = []
        for row in table.findall(f"{_W}tr"):
            cells = ("\n".join(paragraph_text(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc"))
            rows.append(" | ".join(c for c in cells if c))
        if any(rows):
            content.append("\n".join(r for r in rows if r))
    for head in heads:
        for p in head.iter(f"{_W}p"):
            text = paragraph_text(p).strip()
            if text and text not in content:
                content.insert(0, text)
    return ("\n\n".join(content), "ok") if content else ("", "empty: No text found in DOCX file.")


def image_text(data: bytes) -> tuple[str, str]:
    try:
        import pytesseract  # noqa: F401
        from PIL import Image
    except ImportError:
        return "", "error: pytesseract not installed. Run: pip install pytesseract"
    try:
        text = ocr.image_text(Image.open(io.BytesIO(data)))
    except Exception as error:
        return "", f"error: OCR processing failed — {error}"
    return (text, "ok") if text else ("", "empty: No readable text found in image.")


@F.pandas_udf(RESULT)
def opened(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    read = {"docx": docx_text, "image": image_text}
    return pd.DataFrame([read[k](bytes(c if c is not None else b"")) if k in read else ("", "") for k, c in zip(kind, content)], columns=["text", "status"])


# --- PDF files: pages from an adapter, everything else as expressions -------------------------------------------------------

BLOCKS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block_no:int,block_type:int>>"
PAGES = f"struct<status:string,pages:array<struct<no:int,w:double,h:double,blocks:{BLOCKS},images:boolean,ocr:string>>>"
#: A page of fewer words is read by recognition, one with images below the second number; recognition must add so many.
FEW_WORDS, FEW_WORDS_WITH_IMAGES, MORE_WORDS = 30, 55, 10
_BLOCK = ("x0", "y0", "x1", "y1", "text", "block_no", "block_type")


def sparse(words: int, images: bool) -> bool:
    return words < FEW_WORDS or (images and words < FEW_WORDS_WITH_IMAGES)


def library_pages(data: bytes) -> tuple[str, list[dict]]:
    """(status, pages) of a PDF: size, text blocks, whether it has images, and the recognised text of sparse pages.

    A page that fails is left out; a file that cannot be opened or a missing library is a status.
    """
    try:
        import fitz
    except ImportError:
        return "error: PyMuPDF (fitz) not installed. Run: pip install pymupdf", []
    try:
        doc = fitz.open(stream=data, filetype="pdf")
    except Exception as error:
        return f"error: Could not parse PDF — {error}", []
    return "ok", [p for p in (_library_page(doc, k) for k in range(len(doc))) if p]


def _library_page(doc, k: int) -> dict | None:
    try:
        page = doc.load_page(k)
        blocks = [dict(zip(_BLOCK, (*map(float, b[:4]), str(b[4]), int(b[5]), int(b[6])))) for b in page.get_text("blocks")]
        images = bool(page.get_images())
        text = ""
        if sparse(sum(len(b["text"].split()) for b in blocks if b["block_type"] == 0), images):
            try:
                from PIL import Image

                text = ocr.image_text(Image.open(io.BytesIO(page.get_pixmap(dpi=300).tobytes("png"))))
            except Exception:
                text = ""
        return {"no": k + 1, "w": float(page.rect.width), "h": float(page.rect.height), "blocks": blocks, "images": images, "ocr": text}
    except Exception:
        return None


def pages_of(content: Column, read: Callable[[bytes], tuple[str, list[dict]]] = library_pages) -> Column:
    """Struct (status, pages) of PDF bytes; ``read`` is the adapter."""

    @F.pandas_udf(PAGES)
    def opened_pages(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(bytes(d if d is not None else b"")) for d in data], columns=["status", "pages"])

    return opened_pages(content)


def page_text(page: Column) -> Column:
    """A page's blocks in reading order, or its recognised text where the page is sparse and that says more."""
    text = reading_order(page["blocks"], page["w"], page["h"])
    read, seen = word_count(text), word_count(F.coalesce(page["ocr"], F.lit("")))
    few = (read < FEW_WORDS) | (page["images"] & (read < FEW_WORDS_WITH_IMAGES))
    return strip(F.when(few & ((seen > read + MORE_WORDS) | ((read == 0) & (seen > 0))), page["ocr"]).otherwise(text))


def pdf_result(opened_: Column) -> Column:
    """Struct (text, status): pages that have text, each under its number where the file has several."""
    pages = F.coalesce(opened_["pages"], F.array().cast(PAGES.split("pages:", 1)[1][:-1]))
    shown = F.filter(F.transform(pages, lambda p: F.struct(p["no"].alias("no"), page_text(p).alias("text"))), lambda p: p["text"] != "")
    marked = F.transform(shown, lambda p: F.when(F.size(pages) > 1, F.concat(F.lit("\n--- Page "), p["no"].cast("string"), F.lit(" ---\n"), p["text"])).otherwise(p["text"]))
    text = F.array_join(marked, "\n\n")
    status = F.when(opened_["status"] != "ok", opened_["status"]).when(F.size(shown) == 0, "empty: No readable text could be extracted from this PDF.").otherwise("ok")
    return F.struct(text.alias("text"), status.alias("status"))


def extracted(files: DataFrame, path: str = "path", content: str = "content", read_pdf: Callable[[bytes], tuple[str, list[dict]]] = library_pages) -> DataFrame:
    """All columns but the bytes, and kind, text and status.

    Only rows of formats that need Python reach it; null bytes count as an empty file.
    """
    rows = files.withColumn("kind", file_kind(F.col(path)))
    plain = rows.where("kind = 'text'").withColumn("text", clean_extracted(F.coalesce(decoded(F.col(content)), F.lit(""))))
    plain = plain.withColumn("status", F.when(F.col("text") != "", "ok").otherwise("empty: File is empty."))
    other = rows.where("kind in ('docx', 'image')").withColumn("r", opened("kind", content))
    pdf = rows.where("kind = 'pdf'").withColumn("opened", pages_of(F.col(content), read_pdf)).withColumn("r", pdf_result(F.col("opened"))).drop("opened")
    python = other.unionByName(pdf)
    python = python.withColumn("text", F.when(F.col("r.status") == "ok", clean_extracted(F.col("r.text"))).otherwise("")).withColumn("status", F.col("r.status")).drop("r")
    return plain.unionByName(python).drop(content)


def pasted(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(id, resume_str, category, input_source) of texts by name, as typed in or as samples."""
    rows = [(k, text, "Unknown", name) for k, (name, text) in enumerate(texts.items(), 1)]
    return spark.createDataFrame(rows, "id long, resume_str string, category string, input_source string")


#: Three invented resumes to try the analysis on.
SAMPLES = {
    "engineer": "Ines Halvorsen\nines.halvorsen@post.test | +44 7700 900123 | London\n\nSummary\nPlatform engineer who builds data services and keeps them running.\n\nWork Experience\nData Engineer | Corvin Labs | Jan 2019 - Present\nSoftware Developer | Brandt Works | Mar 2015 - Dec 2018\n\n"
    "Skills\nPython, SQL, Docker, Kubernetes, Machine Learning, Git\n\nEducation\nMSc in Computer Science, Halden University\n\nLanguages\nEnglish, Norwegian",
    "analyst": "Tomas Beld\ntomas.beld@post.test\nLocation: Toronto\n\nProfile\nAnalyst for budgets and forecasts of mid-sized firms.\n\nProfessional Experience\nFinancial Analyst at Larch Capital\n2018 - 2023\n\nSkills\nExcel, Forecasting, Budgeting, SQL, Reporting, Valuation\n\nEducation\nMBA in Finance, Redmoor College\n\nCertifications\nCertified Financial Modeller from a Google course",
    "chef": "Rhea Okoro\nrhea@kitchen.example\n\nObjective\nHead of a seasonal kitchen with a small and steady team.\n\nWork History\nExecutive Chef\nHarbour House\n2016 - Present\n\nSkills\nMenu planning, food safety, pastry, catering, inventory management, cooking\n\nEducation\nDiploma in Culinary Arts, Westgate Institute\n\nLanguages\nEnglish, French",
}


# --- pages of text blocks ---------------------------------------------------------------------------------------------


def reading_order(blocks: Column, width: Column, height: Column) -> Column:
    """Text of a page: headers, then columns (right before left) or lines top down, then footers.

    Two columns are taken where the blocks left of 52 % and those right of 35 % of the width make up 85 % of the body; a
    block in both bands comes twice. Blank blocks and images are left out; ties keep the given order.
    """
    text = lambda b: strip(b["text"])
    empty = F.array().cast(BLOCKS)
    usable = F.filter(F.coalesce(blocks, empty), lambda b: F.coalesce(text(b) != "", F.lit(False)) & (F.coalesce(b["block_type"], F.lit(0)) == 0))
    numbered = F.transform(usable, lambda b, i: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), i.alias("i"), b["x1"].alias("x1"), b["y1"].alias("y1"), text(b).alias("t")))
    head = lambda b: b["y1"] <= height * 0.18
    foot = lambda b: ~head(b) & (b["y"] >= height * 0.90)
    body = F.filter(numbered, lambda b: ~head(b) & ~foot(b))
    by_line = lambda a: F.array_sort(a)  # struct order: y, x, given order
    by_top = lambda a: F.array_sort(F.transform(a, lambda b: F.struct(b["y"].alias("y"), b["i"].alias("i"), b["t"].alias("t"))))
    left = F.filter(body, lambda b: b["x1"] <= width * 0.52)
    right = F.filter(body, lambda b: b["x"] >= width * 0.35)
    two = (F.size(left) >= 1) & (F.size(right) >= 1) & (F.size(left) + F.size(right) >= F.size(body) * 0.85)
    texts = lambda a: F.transform(a, lambda b: b["t"])
    middle = F.when(two, F.concat(texts(by_top(right)), texts(by_top(left)))).otherwise(texts(by_line(body)))
    return F.array_join(F.concat(texts(by_line(F.filter(numbered, head))), middle, texts(by_line(F.filter(numbered, foot)))), "\n\n")


def pages_text(pages: DataFrame) -> DataFrame:
    """(resume_id, page_no, text) of each page once."""
    return pages.dropDuplicates(["resume_id", "page_no"]).select("resume_id", "page_no", reading_order(F.col("blocks"), F.col("page_w"), F.col("page_h")).alias("text"))

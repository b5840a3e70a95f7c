import io
import zipfile

from pyspark.sql import functions as F

from scrivane.plans.analyze import analyzed
from scrivane.config import Folders
from scrivane.sources import files, ocr
from scrivane.streaming import analysis

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, header: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def para(t: str) -> str:
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_files(spark):
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr><w:tr><w:tc>{para('c')}</w:tc></w:tr></w:tbl>"
    rows = [
        ("x/a.TXT", "naïve".encode()), ("b.txt", "naïve".encode("latin-1")), ("c.txt", b""), ("d.bin", None), ("e.docx", docx(para("One") + para("") + table, "Head")), ("f.docx", b"no zip"), ("g.pdf", b"%PDF"), ("h.PNG", b"x"), ("i.docx", docx("")),
    ]
    got = {r.path: r for r in files.extracted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["x/a.TXT"].text == got["b.txt"].text == "naïve" and got["b.txt"].status == "ok"
    assert got["c.txt"].status == got["d.bin"].status == "empty: File is empty."
    assert got["e.docx"].text == "Head\n\nOne\n\na | b\nc" and got["e.docx"].status == "ok"
    assert got["f.docx"].status.startswith("error: Could not parse DOCX") and got["i.docx"].status == "empty: No text found in DOCX file."
    assert got["g.pdf"].status.startswith("error:") and got["h.PNG"].status.startswith("error:")


def test_binary_files_and_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert files.extracted(files.read_files(spark, str(tmp_path / "in")).select("path", "content")).first().text == "hello"
    (tmp_path / "c.csv").write_text('ID,Resume_str,Resume_html,Category\n1,"two\nlines ""q""",<p>x</p>,HR\n')
    assert tuple(files.read_corpus_csv(spark, str(tmp_path / "c.csv")).first()) == (1, 'two\nlines "q"', "<p>x</p>", "HR")


def block(x0, y0, x1, y1, text, kind=0):
    return (float(x0), float(y0), float(x1), float(y1), text, 0, kind)


def test_reading_order(spark):
    kind = "k string, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block_no:int,block_type:int>>"
    rows = [
        ("header", [block(0, 0, 10, 10, "H")]),
        ("columns", [block(0, 30, 40, 40, "L1"), block(60, 30, 90, 40, "R1"), block(0, 50, 40, 60, "L2"), block(0, 95, 40, 99, "F"), block(0, 1, 90, 5, "H")]),
        ("single", [block(0, 50, 90, 60, "two"), block(0, 30, 90, 40, " one ")]),
        ("image", [block(0, 30, 40, 40, "pic", 1), block(0, 50, 90, 60, "  ")]),
        ("both", [block(36, 30, 50, 40, "B")]),
        ("none", []),
        ("null", None),
    ]
    df = spark.createDataFrame(rows, kind).select("k", files.reading_order(F.col("blocks"), F.lit(100.0), F.lit(100.0)).alias("t"))
    assert dict(df.collect()) == {"header": "H", "columns": "H\n\nR1\n\nL1\n\nL2\n\nF", "single": "one\n\ntwo", "image": "", "both": "B\n\nB", "none": "", "null": ""}


def test_stream_equals_batch(spark, tmp_path):
    text = "Jane Roe\njane@roe.org\nSkills\nPython and data tools for the kitchen manager who has profile and summary experience of many years in teams"
    batch = spark.createDataFrame([(k, text, "HR") for k in range(5)], "id long, resume_str string, category string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = analysis.parquet_stream(spark, str(tmp_path / "in"), "id long, resume_str string, category string")
    analysis.start_analysis(stream, {"python": "Python"}, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "gate_status", "skills", "recommendation.ats_score").orderBy("id").collect()
    assert got == analyzed(batch, {"python": "Python"}).select("id", "gate_status", "skills", "recommendation.ats_score").orderBy("id").collect() and got[0].gate_status == "ok"


def page(no, blocks, images=False, ocr=""):
    names = ("x0", "y0", "x1", "y1", "text", "block_no", "block_type")
    return {"no": no, "w": 100.0, "h": 100.0, "blocks": [dict(zip(names, b)) for b in blocks], "images": images, "ocr": ocr}


def test_pdf_pages_are_ordered_chosen_and_joined(spark):
    many = " ".join(f"w{k}" for k in range(40))
    opened = {
        b"two": ("ok", [page(1, [block(60, 30, 90, 40, many), block(0, 30, 40, 40, "left")]), page(3, [block(0, 30, 90, 40, "few words")], ocr="seen " * 20)]),
        b"one": ("ok", [page(1, [block(0, 50, 90, 60, "b"), block(0, 30, 90, 40, "a")], ocr="only " * 5)]),
        b"scan": ("ok", [page(1, [], ocr="read"), page(2, [])]),
        b"pictures": ("ok", [page(1, [block(0, 30, 90, 40, many)], True, "x " * 60)]),
        b"none": ("ok", []),
        b"bad": ("error: Could not parse PDF — x", []),
    }
    rows = [(f"{k}.pdf", v) for k, v in enumerate(opened)]
    got = {r.path: r for r in files.extracted(spark.createDataFrame(rows, "path string, content binary"), read_pdf=lambda data: opened[data]).collect()}
    assert got["0.pdf"].text == f"--- Page 1 ---\n{many}\n\nleft\n\n\n--- Page 3 ---\n{('seen ' * 20).strip()}"
    assert got["1.pdf"].text == "a\n\nb" and got["1.pdf"].status == "ok"
    assert got["2.pdf"].text == "--- Page 1 ---\nread" and got["3.pdf"].text == ("x " * 60).strip()
    assert got["4.pdf"].status.startswith("empty: No readable") and got["5.pdf"].status.startswith("error: Could not parse PDF")


class Form:
    def __init__(self, name, size=(1000, 1000)):
        self.name, self.size = name, size

    def crop(self, box):
        return Form(f"{self.name}{box}")


def test_readings_compete_by_words():
    texts = {("a", 3): "one two", ("b", 3): "one two three " * 15, ("a", 1): "x"}
    read = lambda form, mode: texts[form.name, mode]  # noqa: E731  (a reading that fails raises)
    assert ocr.recognised([Form("a"), Form("b")], read) == texts["b", 3].strip()
    sparse = {("a", 3): "one two", ("a", 1): "one two three", ("a", 6): "x", ("a", 11): "one two six"}
    assert ocr.recognised([Form("a")], lambda form, mode: sparse[form.name, mode]) == "one two three"
    assert ocr.recognised([], read) == "" and ocr.recognised([Form("none")], read) == ""


def test_columns_win_where_both_hold_text():
    left, right = "l " * 16, "r " * 26
    parts = {"a(0, 0, 1000, 150)": "head", "a(360, 150, 1000, 1000)": right, "a(0, 150, 380, 1000)": left}
    read = lambda form, mode: parts.get(form.name, "w " * 40)
    assert ocr.recognised([Form("a")], read) == "\n\n".join(("head", right.strip(), left.strip()))
    parts["a(0, 150, 380, 1000)"] = "too few"
    assert ocr.recognised([Form("a")], read) == ("w " * 40).strip()


def test_sizes_places_and_folders():
    assert ocr.scaled_size(600, 800) == (2400, 3200) and ocr.scaled_size(2000, 100) == (4000, 200) and ocr.scaled_size(3000, 10) == (3000, 10) and ocr.scaled_size(6000, 600) == (3000, 300)
    assert ocr.find_engine(("/nowhere/engine",)) in (None, ocr.find_engine())
    at = Folders("s3a://bucket/base/")
    assert (at.data("a.csv"), at.models("m"), at.results()) == ("s3a://bucket/base/data/a.csv", "s3a://bucket/base/models/m", "s3a://bucket/base/results")


def test_samples_pass_the_gate(spark):
    rows = {r.input_source: r for r in analyzed(files.pasted(spark, files.SAMPLES), {"python": "Python", "excel": "Excel", "pastry": "Pastry"}, source="input_source").collect()}
    assert {k: (r.gate_status, r.name, r.skills) for k, r in rows.items()} == {"engineer": ("ok", "Ines Halvorsen", ["Python"]), "analyst": ("ok", "Tomas Beld", ["Excel"]), "chef": ("ok", "Rhea Okoro", ["Pastry"])}
    assert [tuple(e) for e in rows["engineer"].experience_entries][0] == ("Data Engineer", "Corvin Labs", "Jan 2019 - Present")


def test_report_lines(spark, tmp_path):
    from scrivane.operators import metrics

    df = spark.createDataFrame([("m", 0, 0), ("m", 1, 0)], "model string, y_true int, y_pred int")
    lines = metrics.report_text(metrics.report(df, ["model"]), ["model"])
    metrics.save_report(lines.where("value like '%accuracy%'"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == " " * 16 + "accuracy" + " " * 18 + "     0.50" + "        2"

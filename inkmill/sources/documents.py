"""Files as documents (S1 to S4): binaryFile rows, parsed into units in one Python hop, then filtered and joined natively.

DOCX and PPTX are read from their XML with the standard library; PDF needs the optional package pdfplumber.
Errors stand in a column of their own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions import text as tx
from inkmill.operators.filters import is_noise_unit

UNITS = "path string, ftype string, unit_no int, item_no int, top long, left long, heading boolean, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def docx_items(data: bytes) -> Iterator[tuple]:
    """Body paragraphs with text; headings of level 1 or 2 (also 10 and so on: the style's name holds 'Heading 1') begin a section."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                label = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = "" if label is None else label.get(f"{_W}val") or ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    section = 0
    for i, p in enumerate(body.findall(f"{_W}p")):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = "" if style is None else names.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "")
        heading = bool(re.search(r"heading ?[12]", name, re.I))
        if text:
            section += heading
            yield section, i, None, None, heading, text


def pptx_items(data: bytes) -> Iterator[tuple]:
    """Shapes with text: slide, order, top and left (0 where a shape has none)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for number, name in enumerate(slides):
            for i, shape in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_P}sp")):
                rows = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
                if text := "\n".join(rows).strip():
                    off = shape.find(f".//{_A}off")
                    top, left = (0, 0) if off is None else (int(off.get("y") or 0), int(off.get("x") or 0))
                    yield number, i, top, left, False, text


def pdf_items(data: bytes) -> Iterator[tuple]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for number, page in enumerate(pdf.pages):
            if text := page.extract_text():
                yield number, 0, None, None, False, text


READERS = {"docx": docx_items, "pptx": pptx_items, "pdf": pdf_items}


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in UNITS.split(", ")]
    for batch in batches:
        rows = []
        for path, ftype, content in zip(batch["path"], batch["ftype"], batch["content"], strict=True):
            try:
                rows += [(path, ftype, *item, None) for item in READERS[ftype](content)]
            except Exception as e:  # a broken file is a row with its error, not a failed job
                rows.append((path, ftype, None, None, None, None, None, None, f"{ftype}: {type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=columns)


def read_units(files: DataFrame) -> DataFrame:
    """Items of files (path, content) whose suffix, in lower case, is docx, pptx or pdf."""
    typed = files.withColumn("ftype", F.lower(F.element_at(F.split("path", r"\."), -1))).where(F.col("ftype").isin(*READERS))
    return typed.select("path", "ftype", "content").mapInPandas(_parsed, UNITS)


def assemble(units: DataFrame) -> DataFrame:
    """path, ftype, text, error: items joined to units in reading order, noise units dropped, units joined by a blank line.

    Of a DOCX file whose sections are all noise, the whole text counts as one unit.
    """
    ok = units.where("error IS NULL")
    order = F.struct(F.coalesce("top", F.lit(0)), F.coalesce("left", F.lit(0)), "item_no", "text")
    sections = ok.groupBy("path", "ftype", "unit_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "\n").alias("text"))
    whole = Window.partitionBy("path")
    kept = sections.withColumn("keep", ~is_noise_unit(F.col("text"))).withColumn("some", F.max("keep").over(whole))
    joined = kept.groupBy("path", "ftype").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("unit_no", "text")))), lambda s: s["text"]), "\n\n").alias("good"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda s: s["text"]), "\n").alias("all"),
    )
    text = F.when(F.col("good") != "", F.col("good")).when((F.col("ftype") == "docx") & ~is_noise_unit(F.col("all")), F.col("all"))
    done = joined.select("path", "ftype", text.alias("text"), F.when(text.isNull(), F.concat("ftype", F.lit(": no content is left"))).alias("error"))
    return done.unionByName(units.where("error IS NOT NULL").select("path", "ftype", F.lit(None).cast("string").alias("text"), "error"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return assemble(read_units(files.select("path", "content")))


def compat_text(documents: DataFrame) -> DataFrame:
    """Text with an error in its place as '[Error ...]'."""
    return documents.select("path", F.coalesce("text", F.concat(F.lit("[Error "), F.upper("ftype"), F.lit(": "), "error", F.lit("]"))).alias("text"))


def turns(conversations: DataFrame) -> DataFrame:
    """Table rows as units: one document per conversation, its turns in order, without noise."""
    rows = conversations.where(tx.n_words(F.col("text")) > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda s: s["text"]), "\n\n").alias("text"))

"""Text and images of uploaded files, as segments and image rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_extracted
from ..operators.documents import packed_segments

# Kinds of segments and how their places are named; groups of rich text that hold no words, its escapes by code, what its marks become, and escaped characters.
KINDS = {"pdf": ("file_pdf", "page"), "pptx": ("file_slide", "slide"), "rtf": ("file_rtf", "chunk"), "txt": ("file_text", "chunk")}
GROUPS = ("fonttbl", "colortbl", "stylesheet", "info")
CODE, MARKS, ESCAPED = r"\\'([0-9a-fA-F]{2})", ((r"\\par[d]?", "\n"), (r"\\line", "\n"), (r"\\[a-zA-Z]+\d* ?", " ")), ((r"\{", "{"), (r"\}", "}"), (r"\\", "\\"))


def _reader() -> Callable[[str, bytes], Iterator[tuple[int, str]]]:
    """A function made here goes to the workers by value: they need not have this package."""

    def decoded(raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    def rich(text: str) -> str:
        """The words of rich text, roughly: groups of tables and control words go, escapes and paragraph marks are resolved."""
        for g in GROUPS:
            text = re.sub(r"{\\" + g + r".*?}", " ", text, flags=re.DOTALL)
        text = re.sub(CODE, lambda m: chr(int(m[1], 16)), text)
        for pattern, by in MARKS:
            text = re.sub(pattern, by, text)
        for escaped, by in ESCAPED:
            text = text.replace(escaped, by)
        return text.replace("{", " ").replace("}", " ")

    def slides(raw: bytes) -> Iterator[tuple[int, str]]:
        a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
            for number, name in names:
                shapes = []
                for body in ElementTree.fromstring(z.read(name)).iter():
                    if body.tag.endswith("}txBody"):
                        shapes.append("\n".join("".join(t.text or "" for t in p.iter(f"{a}t")) for p in body.iter(f"{a}p")))
                yield number, "\n".join(s for s in shapes if s)

    def pages(raw: bytes) -> Iterator[tuple[int, str]]:
        try:
            import fitz

            for i, page in enumerate(fitz.open(stream=raw, filetype="pdf"), 1):
                yield i, page.get_text("text") or ""
            return
        except ImportError:
            pass
        import pypdf  # neither: the caller reports the file as unreadable

        for i, page in enumerate(pypdf.PdfReader(io.BytesIO(raw)).pages, 1):
            yield i, page.extract_text() or ""

    def read(kind: str, raw: bytes) -> Iterator[tuple[int, str]]:
        if kind == "pdf":
            yield from pages(raw)
        elif kind == "pptx":
            yield from slides(raw)
        else:
            yield 0, rich(decoded(raw)) if kind == "rtf" else decoded(raw)

    return read


def kind_of(name):
    """How a file of this name is read."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".pptx") | low.endswith(".ppt"), "pptx").when(low.endswith(".rtf"), "rtf").otherwise("txt")


def file_pages(files: DataFrame) -> DataFrame:
    """(file_id, material_id, kind, page, text, warning): a row for each page or slide, one for a file of another kind, and one with a warning for a file that can't be read.

    files: id, material_id, original_filename, content. A file is read by one task, by itself; a broken one doesn't stop the others.
    """
    some = files.select(F.col("id").alias("file_id"), "material_id", "original_filename", kind_of(F.col("original_filename")).alias("kind"), "content")
    ids = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in ("file_id", "material_id"))
    read = _reader()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part.itertuples(index=False):
                rows = []
                try:
                    for page, text in read(f.kind, bytes(f.content or b"")):
                        rows.append((f.file_id, f.material_id, f.original_filename, f.kind, page, text, None))
                except Exception as e:  # noqa: BLE001  whatever a broken file causes, other files go on
                    rows.append((f.file_id, f.material_id, f.original_filename, f.kind, -1, "", f"{f.original_filename}: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["file_id", "material_id", "original_filename", "kind", "page", "text", "warning"])

    return some.mapInPandas(run, f"{ids}, original_filename string, kind string, page int, text string, warning string")


def extract(files: DataFrame, size: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(segments; warnings (file_id, warning)). Segments: file_id, material_id, source_kind, source_locator, page_ref, page_index, content_text, char_count, in order of page and chunk.

    Pages and slides are cut to chunks by themselves and named page:3.1 or slide:3.1; other files are cut as a whole and named chunk:1.
    """
    pages = file_pages(files)
    whole = F.col("kind").isin("rtf", "txt")
    cut = pages.filter("page >= 0").select("file_id", "material_id", "original_filename", "kind", "page", F.posexplode(packed_segments(clean_extracted(F.col("text")), size)).alias("at", "content_text"))
    source = F.create_map(*[F.lit(x) for k, (s, _) in KINDS.items() for x in (k, s)])[F.col("kind")]
    ref = F.when(whole, F.format_string("chunk:%d", F.col("at") + 1)).when(F.col("kind") == "pdf", F.format_string("page:%d.%d", "page", F.col("at") + 1)).otherwise(F.format_string("slide:%d.%d", "page", F.col("at") + 1))
    segments = cut.select("file_id", "material_id", source.alias("source_kind"), F.col("original_filename").alias("source_locator"), ref.alias("page_ref"), F.when(whole, F.col("at") + 1).otherwise(F.col("page")).alias("page_index"), "content_text", F.length("content_text").alias("char_count"))
    none = files.select(F.col("id").alias("f_id"), "original_filename").join(segments.select("file_id").distinct(), F.col("f_id") == F.col("file_id"), "left_anti")
    broken = pages.filter("warning IS NOT NULL").select("file_id", "warning")
    empty = none.join(broken.select(F.col("file_id").alias("b")), F.col("f_id") == F.col("b"), "left_anti").select(F.col("f_id").alias("file_id"), F.concat("original_filename", F.lit(": no text found")).alias("warning"))
    return segments, broken.union(empty)


def embedded_images(files: DataFrame) -> DataFrame:
    """(file_id, material_id, name, content): the pictures that slide files hold. Other files, and broken ones, give none."""
    some = files.filter(kind_of(F.col("original_filename")) == "pptx").select(F.col("id").alias("file_id"), "material_id", "content")
    ids = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in ("file_id", "material_id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part.itertuples(index=False):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(f.content or b""))) as z:
                        found = [(f.file_id, f.material_id, posixpath.basename(n), z.read(n)) for n in sorted(z.namelist()) if n.startswith("ppt/media/")]
                except zipfile.BadZipFile:
                    found = []
                yield pd.DataFrame(found, columns=["file_id", "material_id", "name", "content"])

    return some.mapInPandas(run, f"{ids}, name string, content binary")

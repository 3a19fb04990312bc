"""Readers of uploaded documents: txt, docx and (where a reader is given) pdf, by suffix.

Millions of small files are listed and read by the tasks: the driver sees the paths that it is called with, a task lists a
folder, and files are opened some at a time. write_texts deals its files into folders of about FOLDER_FILES, so that a folder is a
small piece of work; the files of one flat folder are listed by one task and read by all.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 10 * 1024 * 1024
#: Files of a folder that write_texts makes, about; files and bytes that a reading task holds, about.
FOLDER_FILES, BATCH_FILES, BATCH_BYTES = 1000, 500, 1 << 22
#: Values of an Arrow column that are Python objects at once, and their bytes, about.
PIECE_VALUES, PIECE_BYTES = 256, 1 << 20
# Fixed value: the name space of docx texts.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def by_pieces(column: pa.Array, one: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """one(value) of every value (null of null), some values at a time: whatever the batch holds, few are Python objects at once."""
    step = max(1, min(PIECE_VALUES, PIECE_BYTES * len(column) // max(column.nbytes, 1)))
    for k in range(0, len(column), step):
        yield pa.array([None if v is None else one(v) for v in column.slice(k, step).to_pylist()], kind)


@F.arrow_udf(T.StringType())
def docx_text(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Paragraphs of a docx file, joined by line feeds."""

    def one(raw: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{{{WORD}}}t")) for p in root.iter(f"{{{WORD}}}p"))

    for column in content:
        yield from by_pieces(column, one, pa.string())


def document_text(suffix: Column, content: Column, pdf_text: Callable[[Column], Column] | None = None) -> Column:
    """The text of a document's bytes by its suffix (lower case); other suffixes raise an error."""
    pdf = pdf_text(content) if pdf_text else F.raise_error(F.lit("no pdf reader was given")).cast("string")
    text = F.when(suffix == "txt", F.decode(content, "UTF-8")).when(suffix == "docx", docx_text(F.when(suffix == "docx", content))).when(suffix == "pdf", pdf)
    return text.otherwise(F.raise_error(F.concat(F.lit("unsupported file format: "), suffix)).cast("string"))


def _listed(roots: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is directly in each root: files with their lengths, folders with -1. head: what stands before the file system's own path in a URI."""
    for f in roots:
        for uri, shown in zip(f["uri"], f["shown"], strict=True):
            fs, base = FileSystem.from_uri(uri)
            at = fs.get_file_info(base)
            found = [at] if at.type == FileType.File else fs.get_file_info(FileSelector(base))
            for k in range(0, len(found), 10_000):
                seen = [x for x in found[k : k + 10_000] if _shown(x.base_name)]
                yield pd.DataFrame({"uri": uri, "head": shown.removesuffix(base), "path": [x.path for x in seen], "length": [x.size if x.is_file else -1 for x in seen]})


def _shown(name: str) -> bool:
    """Names that Spark's readers don't pass over."""
    return not name.startswith(("_", "."))


def _contents(listed: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, length and content (null over MAX_BYTES) of the listed files and of all files in the listed folders."""
    rows, held = [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "length", "content"])

    for f in listed:
        for uri, head, path, length in zip(f["uri"], f["head"], f["path"], f["length"], strict=True):
            fs, _ = FileSystem.from_uri(uri)
            if length >= 0:
                found = [(path, length)]
            else:
                below = fs.get_file_info(FileSelector(path, recursive=True))
                found = [(x.path, x.size) for x in below if x.is_file and all(map(_shown, x.path[len(path) + 1 :].split("/")))]
            for at, size in found:
                content = None
                if size <= MAX_BYTES:
                    with fs.open_input_stream(at) as src:
                        content = src.read()
                    held += size
                rows.append((head + at, size, content))
                if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield frame()
                    rows, held = [], 0
    if rows:
        yield frame()


def read_documents(spark: SparkSession, path: str, pdf_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, suffix, n_bytes and raw_text of the files under path (a file, a folder with its folders, or a pattern of those); other suffixes and files over MAX_BYTES raise an error."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    roots = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    if not roots:
        raise FileNotFoundError(path)
    roots = spark.createDataFrame([(r.getPath().toUri().toString(), r.getPath().toString()) for r in roots], "uri string, shown string")
    listed = roots.mapInPandas(_listed, "uri string, head string, path string, length long")
    files = listed.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInPandas(_contents, "path string, length long, content binary")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    checked = F.when(F.col("length") > MAX_BYTES, F.raise_error(F.lit("file too large")).cast("string")).otherwise(document_text(suffix, F.col("content"), pdf_text))
    return files.select("path", suffix.alias("suffix"), F.col("length").alias("n_bytes"), checked.alias("raw_text"))


def write_texts(rows: DataFrame, path: str, folder_files: int = FOLDER_FILES) -> None:
    """One file for each row (name, text) in folders under path, of about folder_files each, by the tasks; the name decides the folder, so a task that runs again writes the same."""
    folder = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)
    folders = -(-rows.count() // folder_files)
    dealt = rows.select("name", "text", F.pmod(F.xxhash64("name"), F.lit(max(folders, 1))).alias("folder"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(path) if ":" in path else (LocalFileSystem(), path)
        for f in frames:
            for name, text, k in zip(f["name"], f["text"], f["folder"], strict=True):
                at = f"{base}/{k}/{name}"
                try:
                    out = fs.open_output_stream(at)
                except FileNotFoundError:
                    fs.create_dir(f"{base}/{k}", recursive=True)
                    out = fs.open_output_stream(at)
                with out:
                    out.write((text or "").encode())
            yield f[["name"]]

    dealt.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def hrefs(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each link of each page; html has one page (the document page of a link, 1)."""
    return pages.withColumn("page", F.lit(1)).withColumn("href", F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)))

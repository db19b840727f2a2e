"""Library files as segments: text and word-processor files, and pages delivered by a PDF parser."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text

PATTERN = "*.{pdf,docx,txt,PDF,DOCX,TXT}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "source_name string, file_path string, file_type string, page_number int, document_id string, text string, error string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def heading_prefix(style: str) -> str:
    """Number signs for a heading style by its level, one for a title, else nothing."""
    s = (style or "").lower()
    if "heading" in s:
        level = re.search(r"\d", s)
        return "#" * max(1, min(6, int(level[0]) if level else 1)) + " "
    return "# " if "title" in s else ""


def table_text(rows: list[list[str]], keep_empty: bool = False) -> str:
    """Cells joined by bars, one line a row; rows without text are dropped, empty cells too unless kept."""
    lines = []
    for row in rows:
        cells = [" ".join((c or "").split()) for c in row]
        if any(cells):
            lines.append(" | ".join(cells if keep_empty else [c for c in cells if c]))
    return "\n".join(lines)


def docx_text(content: bytes) -> str:
    """Paragraphs with heading marks and tables, in order of the document's body."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    text_of = lambda node: "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" if t.tag == f"{WORD}br" else "" for t in node.iter())
    parts = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            if s := " ".join(text_of(node).split()):
                parts.append(heading_prefix(style.get(f"{WORD}val", "") if style is not None else "") + s)
        elif node.tag == f"{WORD}tbl":
            rows = [["".join(text_of(p) for p in cell.iter(f"{WORD}p")) for cell in row.findall(f"{WORD}tc")] for row in node.iter(f"{WORD}tr")]
            if s := table_text(rows):
                parts.append(s)
    return "\n\n".join(parts)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Library files of a folder, not of folders below it: ``path, length, content, modificationTime``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(folder)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of arriving files."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", PATTERN).load(folder)


def segments_of(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Segments of files: ``source_name, file_path, file_type, page_number, document_id, text, error``.

    A PDF gives one row for each page with text, from the parser that is passed in; other files give one. A file that
    cannot be read, or a PDF without parser, gives one row with its ``error`` and no text and stops no other file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1]
                stem, _, ext = name.rpartition(".")
                kind = ext.lower()
                try:
                    if kind == "pdf":
                        if pdf_pages is None:
                            raise ValueError("no PDF parser")
                        rows += [(name, path, kind, n, f"{stem}_pdf_p{n}", t, None) for n, t in enumerate(pdf_pages(content), 1) if t and t.strip()]
                    else:
                        text = docx_text(content) if kind == "docx" else content.decode("utf-8", "replace")
                        rows.append((name, path, kind, None, f"{stem}_{kind}", text, None))
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    rows.append((name, path, kind, None, f"{stem}_{kind}", None, f"{type(e).__name__}: {e}"[:500]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=NAMES)

    out = files.select("path", "content").mapInArrow(run, SCHEMA)
    return out.withColumn("text", F.nullif(normalize_text(F.col("text")), F.lit("")))


def load_library(spark: SparkSession, folder: str, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Segments of all library files of a folder."""
    return segments_of(read_files(spark, folder), pdf_pages)


def save_index(index: DataFrame, path: str) -> None:
    """Writes an index table in ranges of source and chunk, so that a source's rows are read alone and none is written by
    one task."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(parts, "source_name", "chunk_id").sortWithinPartitions("source_name", "chunk_id").write.mode("overwrite").parquet(path)


def save_state(state: dict, path: str, spark: SparkSession) -> None:
    """Writes a small state as JSON beside its place and then swaps it in, so that a reader never sees half of it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = system.create(new, True)
    out.write(bytearray(json.dumps(state, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(new, target):
        raise OSError(f"cannot replace {path}")


def load_state(path: str, spark: SparkSession) -> dict | None:
    """A state written by ``save_state``; None where there is none or it cannot be read."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        state = json.loads(rows[0].value)
        return state if isinstance(state, dict) else None
    except Exception:  # noqa: BLE001 - a missing or damaged state counts as none
        return None


def store_uploads(uploads: DataFrame, existing: DataFrame, folder: str, most_bytes: int = 50 << 20) -> DataFrame:
    """Writes the uploads that are to be saved into a folder, one file each, and returns the outcomes of all.

    See ``operators.library.upload_outcomes``. Files are written by the tasks through Spark's file system into the
    shared folder; a name that could leave it is never accepted.
    """
    from ..operators.library import upload_outcomes
    from ..session import cut

    outcomes = cut(upload_outcomes(uploads, existing, most_bytes))
    saved = uploads.join(outcomes.where("outcome = 'saved'").select("name"), "name", "left_semi").dropDuplicates(["name"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/.{name}.new") as out:
                    out.write(content)
                system.move(f"{root}/.{name}.new", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    cut(saved.select("name", "content").mapInArrow(write, "name string"))
    return outcomes


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

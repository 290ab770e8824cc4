"""Knowledge-base sources: chunk files, source metadata, document files and regulation texts."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, document_id string, level string, number string, is_annex boolean, page_start int, page_end int, char_count int, text string, _corrupt string"
ALLOWED = ("txt", "docx")
MOST_CHARS = 200_000
MOST_BYTES = 10 * 1024 * 1024
#: Characters of parsed texts after which they are handed on.
PARSED_CHARS = 1 << 20
#: Articles of one text that are handed on together.
SEGMENTS_AT_A_TIME = 1_000
ARTICLE = r"(?m)^\s*(?:GEÇİCİ\s+)?(?:MADDE|Madde)\s+(\d+)"


def read_chunks(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """Chunks of all JSON array files of a folder; unreadable files and rows without text are left out.

    A missing document id is the file's name without its ending.
    """
    rows = spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/{names}")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return rows.withColumn("document_id", F.coalesce("document_id", stem)).filter(F.col("_corrupt").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).drop("_corrupt")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Source metadata (id, title, institution, source_url, publication_date) from a flat list of YAML mappings.

    Read line by line through Spark; nested values are not supported.
    """
    lines = spark.read.text(path, wholetext=True)
    entry = F.explode(F.filter(F.split("value", r"(?m)^\s*-\s+(?=\w+:)"), lambda x: x.rlike(r"(?m)^\s*id:") | x.rlike(r"^id:"))).alias("entry")
    field = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?m)^\s*{name}:\s*(.*)$", 1), r"^[\"']|[\"']\s*$", "")), F.lit("")).alias(name)
    return lines.select(entry).select(*[field(n) for n in ("id", "title", "institution", "source_url", "publication_date")])


def with_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks with their document's title and institution; documents without metadata keep nulls."""
    return chunks.join(metadata.select(F.col("id").alias("document_id"), "title", "institution", "publication_date"), "document_id", "left")


def extract_pages(name: str, raw: bytes, most_chars: int | None = MOST_CHARS) -> list[tuple[int | None, str, bool]]:
    """(page, text, whether it was cut) of a file: text as UTF-8, else Latin-1; word-processor paragraphs.  Other endings give nothing.

    A document counts up to ``most_chars`` characters, the limit of an upload; None takes all.
    """
    ending = name.rsplit(".", 1)[-1].lower()
    if ending not in ALLOWED or len(raw) > MOST_BYTES or not raw:
        return []
    if ending == "txt":
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
    else:
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            xml = box.read("word/document.xml").decode("utf-8")
        paragraphs = ["".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", xml)]
        text = html.unescape("\n".join(p for p in paragraphs if p))
    return [(None, text[:most_chars], most_chars is not None and len(text) > most_chars)]


def parse_files(files: DataFrame, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """(filename, status, page, text) of files (path, content): ``ready``, ``cut`` where a text was longer than allowed, ``error`` without text for a file that fails or is not allowed."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_chars = [], 0
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                try:
                    pages = [p for p in extract_pages(name, raw.as_py() or b"", most_chars) if p[1].strip()]
                except Exception:  # noqa: BLE001 - a broken file is a row, not a failed job
                    pages = []
                out += [(name, "cut" if cut else "ready", p, t) for p, t, cut in pages] or [(name, "error", None, None)]
                n_chars += sum(len(t) for _, t, _ in pages)
                if n_chars >= PARSED_CHARS:
                    yield _parsed(out)
                    out, n_chars = [], 0
            yield _parsed(out)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(parse, "filename string, status string, page int, text string")


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"filename": pa.string(), "status": pa.string(), "page": pa.int32(), "text": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def read_documents(spark: SparkSession, folder: str, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """:func:`parse_files` of all files of a folder."""
    return parse_files(spark.read.format("binaryFile").load(folder), most_chars)


def article_segments(docs: DataFrame, id_col: str, text: str, header: str = ARTICLE) -> DataFrame:
    """One row per article of a regulation text: pos, number, start, end, content; each ends where the next begins.

    A text is read once from its first header to its last, and each article's
    content is cut from it there and then, so the work grows with the text's length and
    the text is not repeated for its articles.  A number that occurs again gets a
    suffix counting its repetitions.  Null texts, and texts without a header, have no row.
    """
    heads = re.compile(header)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pos", "number", "start", "end", "content"]
        for batch in batches:
            for k, value in enumerate(batch.column(1)):
                body, rows, seen, last = value.as_py() or "", [], Counter(), None
                for pos, m in enumerate(heads.finditer(body)):
                    if last is not None:
                        rows.append((*last, m.start(), body[last[2] : m.start()]))
                    number = m[1]
                    seen[number] += 1
                    last = (pos, f"{number}__dup{seen[number] - 1}" if seen[number] > 1 else number, m.start())
                    if len(rows) == SEGMENTS_AT_A_TIME:
                        yield _segments(batch, k, rows, names, id_col)
                        rows = []
                if last is not None:
                    rows.append((*last, len(body), body[last[2] :]))
                    yield _segments(batch, k, rows, names, id_col)

    return docs.select(id_col, text).mapInArrow(cut, f"{id_col} {kind}, pos int, number string, start int, end int, content string")


def _segments(batch: pa.RecordBatch, k: int, rows: list[tuple], names: list[str], id_col: str) -> pa.RecordBatch:
    """Articles of row ``k`` of a batch, with its id."""
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
    ids = batch.column(0).take(pa.array([k] * len(rows)))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[id_col, *names])


def page_of(boundaries: Column, offset: Column) -> Column:
    """The page (from 1) of a text offset: the last page that begins at or before it."""
    return F.greatest(F.lit(1), F.size(F.filter(boundaries, lambda b: b <= offset)))

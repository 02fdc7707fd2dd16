"""Sources: files of many kinds as documents, JSON lines, vectors, and lists of addresses."""

from __future__ import annotations

import csv
import email
import io
import json
import re
import zipfile
from email import policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import lexicons as L
from siltstone.functions import text as X

CHUNK = (
    "chunk_id string, doc_id string, chunk_index int, text string, metadata map<string,string>, information_score double, merged_from array<string>, is_primary boolean, source_file string, _corrupt_record string"
)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder with their extension, kind (null: not supported), id, size and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in L.EXTENSIONS.items() for x in kv])
    key = F.md5(F.concat_ws("_", "path", F.col("modificationTime").cast("double").cast("string"), F.col("length").cast("string")))
    return files.select(key.alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), ext.alias("extension"), kinds[ext].alias("doc_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"), "content")


def is_text(content: Column) -> Column:
    """UTF-8 without a NUL in the first KB."""
    head = F.substring(content, 1, 1024)
    return F.is_valid_utf8(content.cast("string")) & (F.instr(head.cast("string"), "\0") == 0)


def _xml_text(data: bytes, breaks: tuple[str, ...]) -> str:
    parts = []
    for node in ElementTree.fromstring(data).iter():
        tag = node.tag.rpartition("}")[2]
        if tag in breaks:
            parts.append("\n")
        if tag == "t" and node.text:
            parts.append(node.text)
    return "".join(parts).strip()


def sheet_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the filled cells of a workbook, rows and columns from 0, merged ranges filled."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(n.text or "" for n in item.iter() if n.tag.endswith("}t")))
    titles = [n.get("name") for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if n.tag.endswith("}sheet")] if "xl/workbook.xml" in names else []

    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
        col = 0
        for x in letters:
            col = col * 26 + ord(x) - 64
        return int(digits) - 1, col - 1

    out = []
    for i, name in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))):
        title, cells, merged = titles[i] if i < len(titles) else name, {}, []
        for node in ElementTree.fromstring(book.read(name)).iter():
            tag = node.tag.rpartition("}")[2]
            if tag == "c":
                value = "".join(n.text or "" for n in node.iter() if n.tag.rpartition("}")[2] in ("v", "t"))
                if value:
                    cells[place(node.get("r"))] = shared[int(value)] if node.get("t") == "s" else value
            elif tag == "mergeCell":
                merged.append([place(x) for x in node.get("ref").split(":")])
        for (r0, c0), (r1, c1) in (m for m in merged if len(m) == 2):
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    if (r0, c0) in cells:
                        cells[r, c] = cells[r0, c0]
        out += [(title, r, c, v) for (r, c), v in sorted(cells.items())]
    return out


def text_of(data: bytes, kind: str) -> str:
    """The text of a file's bytes; raises what the reader of its kind raises."""
    if kind in ("pdf", "doc", "xls", "ppt"):
        raise ValueError(f"no reader for {kind}: give one as a provider")
    if kind == "docx":
        return _xml_text(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"), ("p", "br"))
    if kind == "pptx":
        book = zipfile.ZipFile(io.BytesIO(data))
        slides = sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return "\n\n".join(_xml_text(book.read(n), ("p",)) for n in slides)
    if kind == "xlsx":
        rows: dict = {}
        for sheet, row, _, value in sheet_cells(data):
            rows.setdefault((sheet, row), []).append(value)
        return "\n".join("\t".join(v) for v in rows.values())
    if kind == "email":
        body = email.message_from_bytes(data, policy=policy.default).get_body(("plain", "html"))
        return body.get_content() if body else ""
    text = data.decode("utf-8-sig")
    if kind == "csv":
        return "\n\n".join("\n".join(f"{k}: {v}" for k, v in row.items()) for row in csv.DictReader(io.StringIO(text)))
    if kind == "json":
        return json.dumps(json.loads(text), ensure_ascii=False)
    if kind == "xml":
        return " ".join(t.strip() for t in ElementTree.fromstring(text).itertext() if t.strip())
    if kind == "markdown":
        return re.sub(r"(?m)^#{1,6}\s+|[*_`]{1,3}|!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    if kind == "html":
        import html

        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", text)
        return html.unescape(bare)
    return text


def extract(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """scan's supported files with their text and, where reading failed or gave none, the error.

    readers: functions from bytes to text by kind, tried before the built-in ones (for PDF and old office files).
    """
    own = readers or {}

    @F.pandas_udf("text string, error string")
    def read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for data, k in zip(content, kind):
            text, error = "", None
            for reader in ([own[k]] if k in own else []) + [lambda d, k=k: text_of(d, k), lambda d: d.decode("utf-8")]:
                try:
                    text = reader(data)
                    if text.strip():
                        error = None
                        break
                    error = error or "no text"
                except Exception as e:  # one bad file must not end the scan; its error is kept in the row
                    error = error or f"{type(e).__name__}: {e}"
            out.append((text if text.strip() else None, None if text.strip() else error))
        return pd.DataFrame(out, columns=["text", "error"])

    found = files.where("doc_type is not null").withColumn("found", read("content", "doc_type"))
    return found.select(*[c for c in files.columns if c != "content"], "found.text", "found.error")


def grid_cells(files: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, value) of the workbooks among scan's files."""

    @F.pandas_udf("array<struct<sheet:string,row:int,col:int,value:string>>")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda d: [{"sheet": s, "row": r, "col": c, "value": v} for s, r, c, v in sheet_cells(d)])

    return files.where("doc_type = 'xlsx'").select("doc_id", F.explode(read("content")).alias("cell")).select("doc_id", "cell.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; malformed lines are left out."""
    rows = spark.read.schema(CHUNK).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json*").json(path)
    return rows.where("_corrupt_record is null and chunk_id is not null").drop("_corrupt_record")


def address_list(lines: DataFrame, done: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Addresses to fetch from lines (line_num, line): http and https with a host, each once, not done yet, in order."""
    url = X.strip(F.col("line"))
    good = lines.select("line_num", url.alias("url")).where("url <> '' and not startswith(url, '#')").where(F.rlike("url", F.lit(r"(?i)^https?://[^/?#\s]+")))
    once = good.withColumn("nth", F.row_number().over(W.partitionBy("url").orderBy("line_num"))).where("nth = 1").select("line_num", "url", F.md5("url").alias("doc_id"))
    left = once if done is None else once.join(done.select("doc_id"), "doc_id", "left_anti").select("line_num", "url", "doc_id")
    out = left.orderBy("line_num")
    return out if most is None else out.limit(most)


def page_name(url: Column) -> Column:
    """A file name for an address: its host and path with underscores."""
    return F.concat(F.regexp_extract(url, r"^[^:]+://([^/?#]+)", 1), F.lit("_"), F.translate(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/", "_"))

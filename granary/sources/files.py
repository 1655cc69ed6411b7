"""File sources, parsers and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.corpus import MAX_BYTES, normalize, override_metadata
from granary.runtime import ship

EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".html")


def scan(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True, max_files: int | None = None) -> DataFrame:
    """Files (path, modificationTime, length, content) below directories, or listed files. Contents are only read for rows that stay.
    ``max_files`` takes the first by path; a missing path gives no rows."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in listed if (x := hadoop.Path(p)).getFileSystem(conf).exists(x)]
    if not there:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there)
    kept = rows.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))
    return kept if max_files is None else kept.orderBy("path").limit(max_files)


def sized(files: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files within the limit, and those over it without their contents."""
    return files.filter(F.col("length") <= limit), files.filter(F.col("length") > limit).drop("content")


class _Text(HTMLParser):
    skip, breaks = {"script", "style", "head", "template"}, {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "ul", "ol", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.skip
        if tag in self.breaks:
            self.parts.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.skip))
        if tag in self.breaks:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """Visible text, blocks set apart by blank lines."""
    p = _Text()
    p.feed(html or "")
    p.close()
    blocks = (" ".join(b.split()) for b in "".join(p.parts).split("\n\n"))
    return "\n\n".join(b for b in blocks if b)


def parse_html(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, text), by the standard library's parser in Arrow batches."""
    ship(pages.sparkSession)
    kind = pages.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "text": [html_text(h) for h in b[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, text string")


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Files with their contents as text bytes. HTML is parsed here; ``parsers`` adds formats by extension, such as PDF. Others are read as UTF-8."""
    known = {".html": lambda b: html_text(b.decode("utf-8", "replace")), **(parsers or {})}
    ship(files.sparkSession)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["content"] = [known[p[p.rindex(".") :].lower()](c).encode() for p, c in zip(b["path"], b["content"], strict=True)]
            yield b

    special = files.filter(ext.isin(*known)).mapInPandas(run, files.schema)
    return files.filter(~ext.isin(*known)).unionByName(special)


def ingest(spark: SparkSession, paths: str | list[str], tenant: str = "default", metadata: dict[str, str] | None = None, **options) -> DataFrame:
    """Scan, size guard, parse, normalise, and the first file of each content; failures are rows with success false."""
    now = options.pop("now", None)
    good, large = sized(scan(spark, paths, **options))
    docs = normalize(parse(good), tenant, now=now).unionByName(normalize(large.withColumn("content", F.lit(None).cast("binary")), tenant, now=now))
    docs = override_metadata(docs, metadata or {})
    ok = docs.filter("success")
    first = ok.groupBy("doc_id").agg(F.min_by(F.struct("text", "success", "errors", "warnings", "metadata"), F.col("metadata")["source_path"]).alias("d")).select("doc_id", "d.*")
    return first.unionByName(docs.filter("not success"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One string column to text files: audit lines, Cypher statements."""
    lines.select(F.col(lines.columns[-1]).alias("value")).write.mode(mode).text(path)

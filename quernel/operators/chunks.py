"""Documents in sections: lines, headings, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.text import HEADING

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"  # fixed values
OUTER_SPACE = r"\A(?U:\s)+|(?U:\s)+\z"
MEDIA = {".md": "text/markdown", ".txt": "text/plain"}  # fixed values


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, content, status) of all files below a path: ok, unsupported, not_utf8 or empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return decode_documents(files.select(F.col("path").alias("source"), "content"))


def decode_documents(files: DataFrame) -> DataFrame:
    """Status and text of (source, content) rows, content being bytes."""
    suffix = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    status = (
        F.when(~suffix.isin(*MEDIA), "unsupported").when(text.isNull(), "not_utf8").when(~text.rlike(r"(?U:\S)"), "empty").otherwise("ok")
    )
    return files.select("source", F.when(status == "ok", text).alias("content"), status.alias("status"))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line)"""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, LINE_END)).alias("line_no", "line"))


def sections(rows: DataFrame, is_heading: Column, title: Column) -> DataFrame:
    """Lines (id, line_no, line) that are no headings, with the section they stand under: the last heading before them."""
    order = Window.partitionBy("id").orderBy("line_no")
    marked = rows.withColumn("is_heading", F.coalesce(is_heading, F.lit(False))).withColumn("title", title)
    marked = marked.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(order))
    marked = marked.withColumn("section", F.last(F.when(F.col("is_heading"), F.col("title")), ignorenulls=True).over(order))
    return marked.filter("NOT is_heading").drop("is_heading", "title")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """(id, index, section, content) of readable documents (source, content): Markdown in sections, other text as one chunk."""
    is_markdown = F.lower("source").endswith(".md")
    text = documents.filter(~is_markdown).select(
        F.col("source").alias("id"), F.lit(0).alias("index"), F.lit(None).cast("string").alias("section"), F.regexp_replace("content", OUTER_SPACE, "").alias("content")
    )
    return chunk(documents.filter(is_markdown), "source", "content").unionByName(text.filter("content <> ''"))


def chunk(docs: DataFrame, id_col: str, text_col: str, is_heading: Column | None = None, title: Column | None = None) -> DataFrame:
    """(id, index, section, content): one chunk for each section that holds more than white space, trimmed."""
    heading = F.col("line").rlike(HEADING) if is_heading is None else is_heading
    name = F.trim(F.regexp_extract("line", HEADING, 2)) if title is None else title
    body = sections(lines(docs, id_col, text_col), heading, name)
    joined = body.groupBy("id", "section_no").agg(
        F.first("section", ignorenulls=True).alias("section"), F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line"))).getField("line"), "\n").alias("content")
    )
    trimmed = joined.withColumn("content", F.regexp_replace("content", OUTER_SPACE, "")).filter("content <> ''")
    index = F.row_number().over(Window.partitionBy("id").orderBy("section_no")) - 1
    return trimmed.select("id", index.alias("index"), "section", "content")


def document_context(chunks: DataFrame) -> DataFrame:
    """(id, context): the chunks of a document as one text, each under its number, source and section."""
    block = F.concat(
        F.lit("[CHUNK "), F.col("index").cast("string"), F.lit("]\nSOURCE: "), F.col("id").cast("string"), F.lit("\nSECTION: "), F.coalesce(F.nullif("section", F.lit("")), F.lit("N/A")), F.lit("\n"), "content"
    )
    ordered = F.array_sort(F.collect_list(F.struct("index", block.alias("block")))).getField("block")
    return chunks.groupBy("id").agg(F.array_join(ordered, "\n\n").alias("context"))


def prepare_context(documents: DataFrame) -> DataFrame:
    """(source, document_name, stage, errorMessage, chunk_count, context) of every document (source, content: bytes): readable ones with
    their chunks as text, others with the stage at which they fail."""
    decoded = decode_documents(documents)
    chunks = chunk_documents(decoded.filter("status = 'ok'").select("source", "content"))
    found = document_context(chunks).join(chunks.groupBy("id").agg(F.count("*").alias("chunk_count")), "id").withColumnRenamed("id", "source")
    message = F.when(F.col("status") == "unsupported", "unsupported document type").when(F.col("status") == "not_utf8", "document is not valid UTF-8").when(F.col("status") == "empty", "document is empty")
    stage = F.when(F.col("status") == "ok", "completed").when(F.col("status") == "unsupported", "document_type").otherwise("document_read")
    rows = decoded.select("source", F.substring_index("source", "/", -1).alias("document_name"), stage.alias("stage"), message.alias("errorMessage"))
    return rows.join(found, "source", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))

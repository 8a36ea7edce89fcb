"""File sources and report sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import normalize

#: What a media type is read as.
MEDIA_TYPES = {
    "text/plain": "text", "text/markdown": "markdown", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
}
#: Parts of attribute names that never leave the process.
DENIED_ATTRIBUTES = (
    "api_key", "authorization", "content", "document", "evidence", "key", "prompt", "query", "secret", "token", "url", "user", "workspace",
)


def source_type(media_type: Column) -> Column:
    """The kind of source; an unknown type is an error, not a null."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    kind = F.try_element_at(known, F.lower(F.trim(F.split(media_type, ";")[0])))
    return F.when(kind.isNull(), F.raise_error(F.concat(F.lit("unsupported media type "), media_type)).cast("string")).otherwise(kind)


def read_texts(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """(path, text, metadata) of UTF-8 files, a byte order mark aside. Bad bytes fail the read; Markdown stays verbatim."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    bare = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.validate_utf8(bare.cast("string"))
    return raw.select("path", (text if kind == "markdown" else normalize(text)).alias("text"), F.create_map(F.lit("format"), F.lit(kind)).alias("metadata"))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, text) of PDF or DOCX files, if the reading library is installed on the executors."""

    def read(batches):
        import io

        for rows in batches:
            texts = []
            for content in rows["content"]:
                if kind == "pdf":
                    import pypdf

                    pages = [p.extract_text(extraction_mode="layout") or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                    texts.append("\n\n".join(f"## 第 {i} 页\n\n{t.strip()}" for i, t in enumerate(pages, 1) if t.strip()))
                else:
                    import docx

                    d = docx.Document(io.BytesIO(content))
                    lines = [p.text.strip() for p in d.paragraphs if p.text.strip()]
                    lines += ["\n".join("\t".join(c.text.strip() for c in r.cells) for r in t.rows) for t in d.tables]
                    texts.append("\n\n".join(lines))
            yield pd.DataFrame({"path": rows["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def read_cases(spark: SparkSession, path: str, schema: str, key: str = "id", one_of: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """JSON cases with checks: no key missing or twice, enumerated fields in range. Fails where one does not hold."""
    cases = spark.read.schema(schema).json(path, multiLine=True)
    bad = cases.groupBy(key).count().where(F.col(key).isNull() | (F.trim(F.col(key)) == "") | (F.col("count") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"{key} missing or repeated: {[r[0] for r in bad]}")
    for field, allowed in (one_of or {}).items():
        cases = cases.withColumn(field, F.when(F.col(field).isin(*allowed), F.col(field)).otherwise(F.raise_error(F.concat(F.lit(f"{field}: "), F.col(field))).cast("string")))
    return cases


def write_report(report: DataFrame, path: str) -> None:
    """Refuses to overwrite; Spark's commit makes the write all or nothing."""
    report.write.mode("errorifexists").json(path)


def cache_key(*parts: Column) -> Column:
    return F.concat(F.lit("v1:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def metric_lines(histogram: DataFrame) -> DataFrame:
    """Prometheus text lines of (method, route, le, n), sorted."""
    line = F.format_string('http_request_duration_seconds_bucket{method="%s",route="%s",le="%s"} %d', "method", "route", "le", "n")
    return histogram.select(line.alias("line")).orderBy("line")


def metrics_text(requests: DataFrame, rejections: DataFrame) -> DataFrame:
    """Prometheus text lines (part, line), to be read in this order: request counters, histogram, rejection counters.

    requests: method, route, status_class, seconds; rejections: scope, backend. A histogram is its cumulative buckets,
    its sum and its count for each method and route.
    """
    from tidepool.streaming.state import histogram

    def lines(rows: DataFrame, part: int, name: str, labels: tuple[str, ...], value: str, shown: str = "%d") -> DataFrame:
        text = f"{name}{{{','.join(f'{c}="%s"' for c in labels)}}} {shown}"
        return rows.select(F.lit(part).alias("part"), F.format_string(text, *labels, value).alias("line"))

    kinds = ("method", "route", "status_class")
    by = kinds[:2]
    cells = histogram(requests, list(by), "seconds")
    whole = cells.where("le = '+Inf'")
    parts = [
        lines(requests.groupBy(*kinds).agg(F.count("*").alias("n")), 0, "http_requests_total", kinds, "n"),
        lines(cells, 1, "http_request_duration_seconds_bucket", (*by, "le"), "n"),
        lines(whole, 2, "http_request_duration_seconds_sum", by, "sum", "%.6f"),
        lines(whole, 3, "http_request_duration_seconds_count", by, "count"),
        lines(rejections.groupBy("scope", "backend").agg(F.count("*").alias("n")), 4, "rate_limit_rejections_total", ("scope", "backend"), "n"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def allowed_attributes(attributes: Column) -> Column:
    """The map without keys whose name holds a denied part."""
    return F.map_filter(attributes, lambda k, v: ~F.lower(k).rlike("|".join(DENIED_ATTRIBUTES)))


def backfilled(vectors: DataFrame, dims: int) -> DataFrame:
    """native filled from stored where it is null and has the right number of dimensions."""
    return vectors.withColumn("native", F.when(F.col("native").isNull() & (F.size("stored") == dims), F.col("stored")).otherwise(F.col("native")))


def seed(existing: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of corpus (title, content) whose title is new; a known title with other content is an error."""
    hashed = corpus.withColumn("content_hash", F.sha2("content", 256))
    old = existing.select("title", F.col("content_hash").alias("_old"))
    met = hashed.join(old, "title", "left")
    same = F.when(F.col("_old") != F.col("content_hash"), F.raise_error(F.concat(F.lit("content differs: "), "title")).cast("string")).otherwise(F.col("_old"))
    return met.withColumn("_old", same).where("_old IS NULL").drop("_old")

"""A content-addressed archive of WARC records: payload bytes once for each digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, saved

#: A payload of fewer bytes is never a revisit.
LEAST_BYTES = 100


def _record_id(page_id: Column, digest: Column, again: Column | None = None) -> Column:
    """The id of a page's record of a payload; a row that repeats both has its number added, so no two records share an id."""
    name = F.concat(F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), digest)
    return F.concat(F.lit("<urn:page:"), name if again is None else F.concat(name, F.coalesce(F.concat(F.lit(":"), again.cast("string")), F.lit(""))), F.lit(">"))


def with_types(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """rows (page_id, digest, payload_bytes and any others) with record_type and refers_to.

    Of equal payloads of least bytes or more, the smallest page_id is the response and the others revisit it; rows that tie on the
    smallest one are responses all, and so are rows with a null page_id. Only ids and digests move: the smallest of each digest is found
    with partial aggregates, so a payload that a third of the pages share costs a row for each task; digests of several pages are saved
    and joined, and the join can split a digest that has many rows.
    """
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many"))
    firsts = saved(firsts.where("many > 1").select("digest", "first"), "firsts")
    revisits = F.col("page_id") > F.col("first")
    return rows.join(firsts, "digest", "left").select(
        *rows.columns, F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to")
    )


def write_archive(pages: DataFrame, folder: str | None = None, date: str | Column = "1970-01-01T00:00:00Z", key: str = "page_id", html: str = "html", url: str = "url") -> str:
    """Write the archive of a pages table; its folder. ``payloads`` holds each distinct payload once, ``headers`` each record's exact head.

    The head of a record is its WARC header block and the HTTP head that starts its content; a response's payload follows it, a revisit
    has none. Null html is an empty payload, a null url an empty one; blanks and line ends in a url are written as %20. Repeated rows are
    records of their own, with ids of their own; an empty table is an empty archive; other columns are not archived. date: of all records, or a
    column of the pages.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    data = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    pages.select(F.sha2(data, 256).alias("digest"), data.alias("payload")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"\s", "%20").alias("uri")
    when = (date if isinstance(date, Column) else F.lit(date)).cast("string").alias("date")
    rows = saved(pages.select(F.col(key).cast("long").alias("page_id"), uri, F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("payload_bytes"), when, F.monotonically_increasing_id().alias("row")), "records")
    twice = rows.groupBy("page_id", "digest").agg(F.min("row").alias("first_row"), F.count("*").alias("many")).where("many > 1").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first_row")
    rows = with_types(rows.join(twice, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d"))
    revisit, size = F.col("record_type") == "revisit", F.col("payload_bytes")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"), F.when(F.col("row") != F.col("first_row"), F.col("row"))),
        F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\nWARC-Target-URI: "), F.col("uri"), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("digest")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string"), F.lit("\r\n\r\n"), http,
    )
    rows.select("page_id", "digest", head.cast("binary").alias("head")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, digest, payload (the full one, for revisits too), record (the exact bytes of the WARC record).

    All but page_id come from the stored bytes. A payload whose digest is not the one it is stored under, or whose length is not the one
    its head names, fails the read.
    """
    heads = spark.read.schema("page_id long, digest string, head binary").parquet(f"{folder}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    sound = stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))
    text = F.decode("head", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+):[0-9a-f]+>", 1)
    rows = heads.join(sound, "digest").select(
        "page_id", F.regexp_extract(text, r"\r\nWARC-Type: (\w+)", 1).alias("record_type"), F.when(refers != "", refers).cast("long").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"), F.regexp_extract(text, r"(?s)\r\n\r\n.*Content-Length: (\d+)", 1).cast("long").alias("n"), "payload", "head",
    )
    end = F.lit(b"\r\n\r\n")
    record = F.concat("head", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), end)
    payload = F.when(F.octet_length("payload") == F.col("n"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload has another length than its head says")))
    return rows.select("page_id", "record_type", "refers_to", "digest", payload.alias("payload"), record.alias("record"))

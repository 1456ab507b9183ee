"""Content-addressed WARC archive: payloads once by digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

CRLF = "\r\n"


def header_lines(*lines) -> F.Column:
    """A record's header block; a null line is left out, the block ends with an empty line."""
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 100,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per row below ``path``: ``payloads`` and ``headers``.

    ``payloads`` (payload_digest, payload) holds every distinct payload once, addressed by its SHA-256.
    ``headers`` holds per record its exact header block as it stands in a WARC file, and the digest.
    Of records with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is a
    ``response`` and the others are ``revisit`` records that name it; smaller payloads are always
    ``response`` records.

    A null payload is the empty one; its bytes are stored once too. Rows that share the smallest id
    and the payload are all responses. A row without an id is a revisit of the smallest id, or a
    response if no copy has an id. A null address leaves out its header line; line breaks in an
    address are percent-encoded. Columns other than the three named are ignored.

    Only ids and digests are grouped and joined for the decision; payload bytes are shuffled once,
    to pick one row per digest.
    """
    content = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("record"),
        F.regexp_replace(F.regexp_replace(F.col(uri_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("uri"),
        content.alias("payload"),
        F.sha2(content, 256).alias("digest"),
        F.octet_length(content).cast("bigint").alias("size"),
    )
    # The table of first records is stored so that the join below reads plain exchanges, which
    # adaptive execution splits where one digest holds many records.
    firsts = written(rows.groupBy("digest").agg(F.min("record").alias("first")), "warc-firsts")
    light = rows.select("record", "uri", "digest", "size").join(firsts, "digest", "left")
    revisit = (F.col("size") >= revisit_from) & F.col("first").isNotNull() & ~F.col("record").eqNullSafe(F.col("first"))
    names = light.withColumn("revisit", revisit)
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    number = F.coalesce(F.col("record").cast("string"), F.lit("none"))
    header = header_lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), 0).otherwise(F.col("size")).cast("string")),
    )
    names.select(
        F.col("record").alias(id_col), header.cast("binary").alias("header"), F.col("digest").alias("payload_digest")
    ).write.parquet(f"{path}/headers")
    # Both the join and the removal of repeated rows go by digest and id, so payloads move once.
    key = F.coalesce(F.col("record").cast("string"), F.lit("")).alias("key")
    wanted = firsts.select("digest", F.coalesce(F.col("first").cast("string"), F.lit("")).alias("key"))
    stored = rows.select("digest", key, "payload").join(wanted, ["digest", "key"], "left_semi")
    stored.dropDuplicates(["digest", "key"]).select(F.col("digest").alias("payload_digest"), "payload").write.parquet(
        f"{path}/payloads"
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reconstruct every record of an archive by joining headers with payloads.

    Returns the columns of ``headers`` with ``payload`` (a revisit has the payload it refers to),
    ``record`` (the exact bytes of the record in a WARC file; a revisit carries no payload),
    ``record_type`` and ``refers_to`` as read from the header. A payload that is missing, or whose
    digest is not the one it is stored under, fails the job.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select(
        "payload_digest",
        "payload",
        F.when(F.sha2("payload", 256) == F.col("payload_digest"), True)
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_digest"))).cast("boolean"))
        .alias("verified"),
    )
    found = spark.read.parquet(f"{path}/headers").join(checked, "payload_digest", "left")
    text = F.col("header").cast("string")
    payload = F.when(F.col("verified"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload "), F.col("payload_digest"))).cast("binary")
    )
    revisit = F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1)
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:([^>]*)>\r\n", 1)
    ended = F.lit(CRLF + CRLF).cast("binary")
    return found.withColumns(
        {"payload": payload, "record_type": revisit, "refers_to": F.nullif(refers, F.lit(""))}
    ).withColumn(
        "record",
        F.when(F.col("record_type") == "revisit", F.concat("header", ended)).otherwise(
            F.concat("header", "payload", ended)
        ),
    ).drop("verified")

"""Content-addressed archive of web records.

Payload bytes are stored once under their SHA-256; the exact header block of every record is stored on its own, with
the key of its payload.  Records come back by joining the two.  A key is verified twice: while writing, all payloads
of a key must agree in length and SHA-1; while reading, the stored bytes must give the key again.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response and the
others revisit it; shorter ones are all responses.  A null html is an empty payload; a null url an empty target.  A
repeated id with the same payload gives equal records, each a response if the id is the largest.  A null id is never
the largest unless all ids of the payload are null.  Line breaks cannot stand in a header: those of a url are written
as %0D and %0A.  A payload is one value of a row, so a very long one has to fit into a task's memory once or twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.common import new_folder, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def _field(header: Column, name: str) -> Column:
    """The value of a header line, null where there is none."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(header, F.lit(f"\r\n{name}: ")), value)


def _header(kind: Column, record_id: Column, url: Column, sha1: Column, size: Column, refers: Column) -> Column:
    """Header block of a record, up to and with the empty line."""
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), _name(record_id)),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(refers))),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(size).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes ``<folder>/headers`` (id, header, payload_key) and ``<folder>/payloads`` (payload_key, payload)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_key", F.sha2("payload", 256))
    narrow = stored(rows.select("record_id", "url", "payload_key", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")), "digests")
    agree = (F.min("sha1") == F.max("sha1")) & (F.min("size") == F.max("size"))
    owners = narrow.groupBy("payload_key").agg(F.max("record_id").alias("owner"), agree.alias("agree"))
    owners = owners.select("payload_key", F.when(F.col("agree"), F.col("owner")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("owner"))
    kind = F.when((F.col("size") < min_bytes) | F.col("record_id").eqNullSafe(F.col("owner")), "response").otherwise("revisit")
    headers = narrow.join(owners, "payload_key").withColumn("kind", kind)
    headers.select("record_id", _header(F.col("kind"), F.col("record_id"), F.col("url"), F.col("sha1"), F.col("size"), F.col("owner")).alias("header"), "payload_key").write.parquet(f"{folder}/headers")
    # the owner's bytes only; one column names key and owner, so that equal rows fall together where the join has put them
    def named(record_id: str) -> Column:
        return F.concat_ws(":", "payload_key", F.col(record_id).cast("string")).alias("named")

    first = rows.select("payload_key", "payload", named("record_id")).join(owners.select(named("owner")), "named", "left_semi")
    first.dropDuplicates(["named"]).select("payload_key", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads); reading a payload that does not give its key fails."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("payload_key"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return spark.read.parquet(f"{folder}/headers"), payloads.select("payload_key", checked.alias("payload"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, record``: the bytes of every record as an archive file holds them.

    Responses meet their payloads; a revisit has none of its own, so its payload is not carried to it either.
    """
    headers, payloads = read_archive(spark, folder)
    revisit = _field(F.col("header"), "WARC-Type") == "revisit"

    def record(*body: Column) -> Column:
        return F.concat(F.encode("header", "UTF-8"), *body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record")

    full = headers.where(~revisit).join(payloads, "payload_key").select("record_id", record(F.col("payload")))
    return full.unionAll(headers.where(revisit).select("record_id", record()))


def parsed(found: DataFrame) -> DataFrame:
    """``record_id, kind, told, size, digest, refers`` of records, from their bytes alone.

    ``told`` is the digest in the header, ``size`` and ``digest`` are those of the bytes behind it.
    """
    header = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    lines = F.concat(header, F.lit("\r\n"))
    body = F.substr(F.col("record"), F.octet_length("header") + 3, F.octet_length("record") - F.octet_length("header") - 6)
    kind = found.schema["record_id"].dataType
    refers = F.nullif(F.regexp_extract(_field(F.col("header"), "WARC-Refers-To"), "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    length = _field(F.col("header"), "Content-Length").cast("long")
    size = F.when(F.octet_length(body) == length, length).otherwise(F.raise_error(F.lit("a record is not as long as its header says")))
    return found.select("record_id", "record", lines.alias("header")).select(
        "record_id", _field(F.col("header"), "WARC-Type").alias("kind"), F.regexp_replace(_field(F.col("header"), "WARC-Payload-Digest"), "^sha1:", "").alias("told"),
        size.alias("size"), F.sha1(body).alias("digest"), refers.alias("refers"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: id, size and SHA-1 of the full payload, type and the id it refers to, all read from the rebuilt records.

    A revisit takes its size from the response it refers to, found by id and digest.
    """
    facts = stored(parsed(records(spark, folder)), "records")
    agrees = F.when(F.col("digest") == F.col("told"), F.col("digest")).otherwise(F.raise_error(F.lit("a header does not match its payload")))
    responses = facts.where("kind = 'response'").select("record_id", F.col("size").alias("payload_bytes"), agrees.alias("payload_digest"), "kind", "refers")
    # one row per response that may be referred to; the ids of repeated rows give it more than once
    sizes = responses.select(F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("name"), F.col("payload_digest").alias("told"), "payload_bytes").distinct()
    revisits = facts.where("kind = 'revisit'").withColumn("name", F.coalesce(F.col("refers").cast("string"), F.lit("")))
    back = revisits.join(sizes, ["name", "told"], "left").select(
        "record_id", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit refers to no response")).cast("long")).alias("payload_bytes"), F.col("told").alias("payload_digest"), "kind", "refers")
    return responses.unionAll(back).select("record_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def archive(pages: DataFrame, **columns: str) -> str:
    """Writes a new archive in the shared folder and returns its place."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, **columns)
    return folder

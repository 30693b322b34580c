"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

A reader's tasks cut their part of a file at every magic line, and emit each candidate's offset and that of the successor that its
Content-Length names. Pointer jumping from the start of the file keeps what the chain reaches, so a magic line within a
payload starts no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written
from claimscope.session import scratch_path

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"  # after a head, and after a record
RECORDS_PER_FILE = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hexadecimal digits are four digits of base 32."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, compression: str = "gzip", least_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into WARC files in the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes``, that with the largest page_id is a response, and the others are revisits
    of it; repeated rows with that page_id, and rows without any page_id among their equals, are responses. A null html is an empty
    payload; a null url an empty one; white space in an url is written as %20; a null page_id is named null. No rows give no records.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload")})
    # Only payloads that occur twice need to be looked up.
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).alias("payload")).where(F.octet_length("payload") >= least_bytes)
    repeated = narrow.groupBy(base32_sha1(F.col("payload")).alias("digest")).agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    met = rows.join(repeated, "digest", "left").withColumn("refers", first)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    name = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))
    response = F.col("refers").isNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(GAP)
    )
    block = F.when(response, F.concat(http, "payload")).otherwise(http)
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type: ", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID: ", name("page_id")),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To: ", name("refers")), line("WARC-Profile: " + PROFILE))),
        line("WARC-Date: " + DATE),
        line("WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\p{Cntrl}]", "%20")),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    met.select(record.alias("value")).write.options(
        lineSep=GAP, compression=compression, maxRecordsPerFile=RECORDS_PER_FILE
    ).text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _parsed(pieces: DataFrame) -> DataFrame:
    """Fields of the record that starts at each piece (the text after a magic line); nulls where it starts none."""
    head = F.substring_index("value", GAP, 1)
    length = F.try_to_number(F.nullif(_field(F.col("head"), "Content-Length"), F.lit("")), F.lit("999999999999999999")).cast("bigint")
    raw = pieces.withColumn("head", F.when(F.col("value").contains(GAP), head)).withColumn("length", length)
    raw = raw.withColumn("body_at", (F.octet_length("head") + 4).cast("bigint"))
    whole = F.octet_length("value") >= F.col("body_at") + F.col("length")
    block = F.substring(F.col("value").cast("binary"), (F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    raw = raw.withColumn("block", F.when(whole, block))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), GAP, 1)) + 4
    payload = F.substring(F.col("block"), (http + 1).cast("int"), F.greatest(F.lit(0), F.octet_length("block") - http).cast("int"))
    raw = raw.withColumn("payload", payload)
    page = lambda name: F.regexp_extract(_field(F.col("head"), name), "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    return raw.select(
        *[c for c in pieces.columns if c != "value"], F.col("length").isNotNull().alias("candidate"), (F.col("body_at") + F.col("length") + 4).alias("span"),
        whole.alias("whole"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        _field(F.col("head"), "WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "(?i)^sha1:", "").alias("stated_digest"),
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magic lines, read in parts of files; ``file`` is a hash of its path, ``seq`` orders the pieces of a part."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("seq"), F.xxhash64("value").alias("piece"), F.octet_length("value").cast("bigint").alias("bytes"),
    )


def _reached(candidates: DataFrame) -> DataFrame:
    """Of ``candidates`` (file, part, at, next), those (file, at) on the chain from offset 0 of their file.

    Within a part, candidates that follow each other and that nothing else points at are one run; pointers are doubled over
    runs, so the rounds grow with the logarithm of the runs of a file.
    """
    pointed = candidates.groupBy("file", F.col("next").alias("at")).agg(F.count(F.lit(1)).alias("pointers"))
    order = Window.partitionBy("file", "part").orderBy("at")
    new_run = (F.lag("next").over(order).eqNullSafe(F.col("at")) & (F.col("pointers") == 1)).eqNullSafe(F.lit(False))
    marked = candidates.join(pointed, ["file", "at"], "left").withColumn("start", F.when(F.coalesce(new_run, F.lit(True)), F.col("at")))
    runs = written(marked.withColumn("run", F.last("start", ignorenulls=True).over(order)).select("file", "run", "at", "next"))
    nodes = runs.groupBy("file", F.col("run").alias("at")).agg(F.max("next").alias("to"))
    reach = nodes.where("at = 0").select("file", "at")
    jump = written(nodes.join(nodes.select("file", F.col("at").alias("to")), ["file", "to"]).select("file", "at", "to"))
    while not jump.isEmpty():
        further = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = written(reach.union(further).distinct())
        jump = written(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("on")), ["file", "to"]).select("file", "at", F.col("on").alias("to")))
    return runs.join(reach.withColumnRenamed("at", "run"), ["file", "run"]).select("file", "at")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) for each record of the WARC files in ``path``.

    A revisit has the payload of the response that it refers to, and nulls if there is none. ``verified`` says whether the payload
    has the digest that the record states. A file that doesn't start with a record has none; a chain ends at the first
    record that is cut short. Files without splits (gzip) are read by one task each. An empty folder gives no rows.
    """
    kept = written(_parsed(_pieces(spark, path)))
    parts = kept.groupBy("file", "part").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("size"))
    by_part = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("file", "part", F.coalesce(F.sum("size").over(by_part), F.lit(0)).alias("from"))
    by_seq = Window.partitionBy("file", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = kept.withColumn("inner", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(by_seq), F.lit(0)))
    # A piece's offset is that of the magic line before it; what comes before the first one has a negative offset.
    placed = written(inner.join(starts, ["file", "part"]).withColumn("at", F.col("from") + F.col("inner") - len(MAGIC)))
    candidates = placed.where("candidate AND at >= 0").select("file", "part", "at", (F.col("at") + len(MAGIC) + F.col("span")).alias("next"))
    reached = written(_reached(candidates))
    records = placed.join(reached, ["file", "at"])
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stated_digest"]
    complete = records.where("whole").select(*fields)
    broken = written(records.where("NOT whole").select("file", F.col("at").alias("owner")))
    if not broken.isEmpty():
        complete = complete.union(_joined(spark, path, placed, reached, broken).select(*fields))
    records = written(complete)
    # Written first, so that Spark can split the side of the revisits where very many refer to one response.
    responses = written(records.where("record_type = 'response'").select(
        F.col("page_id").alias("id"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")
    ).dropDuplicates(["id"]))
    revisit = F.col("record_type") == "revisit"
    met = records.join(responses, revisit & (F.col("refers_to") == F.col("id")), "left")
    digest = F.when(revisit, F.col("d")).otherwise(F.col("payload_digest"))
    return met.select(
        "page_id", F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", "refers_to", digest.eqNullSafe(F.col("stated_digest")).alias("verified"),
    )


def _joined(spark: SparkSession, path: str, placed: DataFrame, reached: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from their pieces.

    Pieces are read again; they are told by their file, length and hash, as equal ones can stand for each other.
    """
    files = broken.select("file").distinct()
    marks = placed.join(files, "file", "left_semi").select("file", "at", "piece", "bytes").join(
        reached.withColumn("owner", F.col("at")), ["file", "at"], "left"
    )
    order = Window.partitionBy("file").orderBy("at")
    owned = marks.withColumn("owner", F.last("owner", ignorenulls=True).over(order)).join(broken, ["file", "owner"])
    needed = written(owned)
    texts = _pieces(spark, path).select("value", "file", "piece", "bytes").join(needed.select("file", "piece", "bytes").distinct(), ["file", "piece", "bytes"], "left_semi")
    texts = texts.dropDuplicates(["file", "piece", "bytes"])
    whole = needed.join(texts, ["file", "piece", "bytes"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("pieces")
    )
    value = F.array_join(F.transform("pieces", lambda x: x["value"]), MAGIC)
    return written(_parsed(whole.select("file", "owner", value.alias("value")))).where("whole")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder and read it back; one row per page. Cases as in the two steps."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path)

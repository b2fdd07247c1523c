r"""WARC archives written and read by Spark's own text source, so that any store Spark knows will do.

Writing: a record is a header, an empty line and a block; the text writer's line separator ``\r\n\r\n`` is the end of
the record. Reading: the reader's separator is the version line, the magic of a record, so each row is what lies between
one magic and the next, wherever the file was split. Magic can also stand inside a payload. Therefore each row is only a
candidate: its header gives the offset of its successor, and pointer jumping from the start of the file keeps the
candidates that are reachable from there. Rows that are not reachable are parts of the payload of the reachable one
before them.

Payloads are texts in UTF-8. A null payload is empty. Repeated ids are written as records of their own; ids may be of any type that
has a text form, null among them. An empty table makes archives without records, and an empty result. A record is held in memory as a
whole, a payload of up to 2 GB; nothing is cut off. A payload that doesn't have the digest its record states raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, delete_path, fresh_path, quoted

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Payloads with several pages that are broadcast, some sixty bytes each.
MOST_BROADCAST = 200_000
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: 160 bits are eight groups of 20 bits, each five hex digits or four base32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, RFC4648)


def describe(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row of ``pages``.

    Of the rows with an equal payload of at least ``min_revisit_bytes`` the one with the smallest id is the response
    (all rows with that id, should it repeat; a null id only if no row of the group has one); the others revisit it.
    """
    p = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(payload)), F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload").cast("binary"))})
    groups = (
        p.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    groups = cut(groups)
    if groups.count() <= MOST_BROADCAST:  # else a shuffle of the pages, in which adaptive execution can split a payload that very many share
        groups = F.broadcast(groups)
    p = p.join(groups, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False)) & F.col("_n").isNotNull()
    return p.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")


def _urn(page_id: Column) -> Column:
    """The name of a page in a header; of a null id, one without an id."""
    return F.concat(F.lit("<urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def _id_of(urn: Column, id_type: str) -> Column:
    """The id in such a name; null without one, or if it is none of the type."""
    return F.when(urn.startswith("<urn:page:"), F.url_decode(F.regexp_extract(urn, r"<urn:page:([^>]*)>", 1))).try_cast(id_type)


def write_archives(described: DataFrame, path: str, max_records_per_file: int = 20_000) -> None:
    """One record per row of what ``describe`` returns. A revisit has an empty payload and names the record it repeats."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
    )
    lines = described.withColumn("block", http).select(F.concat(header, F.lit(END), F.col("block")).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", max_records_per_file).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per magic in the archives under ``path``: file, block, place (their order in the file) and value, what follows it."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    )


def header_field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def parse(value: Column, id_type: str = "long") -> dict[str, Column]:
    """Fields of a record from what follows its magic; step is the distance from the magic to the record's successor,
    null without a valid header. payload_bytes and payload_digest are of the payload as it stands in ``value``."""
    head = F.substring_index(value, END, 1)
    length = header_field(head, "Content-Length")
    valid = F.contains(value, F.lit(END)) & length.rlike("^[0-9]{1,18}$")
    start = F.octet_length(head) + len(END)
    block = F.substring(value.cast("binary"), start + 1, F.when(valid, length.cast("long")).cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    payload = F.substring(block, http + 1, F.lit(2**31 - 1))
    return {
        "step": F.when(valid, start.cast("long") + len(MAGIC) + len(END) + length.cast("long")),
        "record_type": header_field(head, "WARC-Type"),
        "url": header_field(head, "WARC-Target-URI"),
        "page_id": _id_of(header_field(head, "WARC-Record-ID"), id_type),
        "refers_to": _id_of(header_field(head, "WARC-Refers-To"), id_type),
        "stated_digest": F.regexp_extract(header_field(head, "WARC-Payload-Digest"), "sha1:(.*)", 1),
        "payload": payload,
    }


def with_offsets(rows: DataFrame) -> DataFrame:
    """``rows`` (file, block, place, size, step, ...) with the offset of each candidate and that of its successor."""
    # the first row of a file is the empty string before its first magic, so offsets begin at minus one magic
    before = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")) - len(MAGIC))
    return placed.withColumn("successor", F.col("offset") + F.col("step")).where("offset >= 0")


def reachable(edges: DataFrame) -> DataFrame:
    """The rows of ``edges`` (file, offset, successor, ...) that a chain from offset 0 of their file reaches.

    Neighbours whose successor is simply the next candidate form a run. Only the ends of runs are followed: each
    points to the run that holds its successor, and pointers are doubled until none is left.
    """
    order = Window.partitionBy("file").orderBy("offset")
    breaks = F.lag("offset").over(order).isNotNull() & ~F.lag("successor").over(order).eqNullSafe(F.col("offset"))
    e = cut(edges.withColumn("_breaks", breaks.cast("int")).withColumn("_run", F.sum("_breaks").over(order)).drop("_breaks"))
    last = e.groupBy("file", "_run").agg(F.max_by("successor", "offset").alias("_entry"))
    holder = e.select("file", F.col("_run").alias("_to"), F.col("offset").alias("_entry"))
    # hop: run -> the run that holds its successor, and where the chain enters that run
    hop = cut(last.join(holder, ["file", "_entry"]).select("file", "_run", "_to", "_entry"))
    reached = e.where("offset = 0").select("file", "_run", F.lit(0).cast("long").alias("_in"))
    while not hop.isEmpty():
        new = reached.join(hop, ["file", "_run"]).select("file", F.col("_to").alias("_run"), F.col("_entry").alias("_in"))
        reached = cut(reached.unionByName(new).groupBy("file", "_run").agg(F.min("_in").alias("_in")))
        further = hop.select("file", F.col("_run").alias("_to"), F.col("_to").alias("_next"), F.col("_entry").alias("_next_entry"))
        hop = cut(hop.join(further, ["file", "_to"]).select("file", "_run", F.col("_next").alias("_to"), F.col("_next_entry").alias("_entry")))
    return e.join(reached, ["file", "_run"]).where("offset >= _in").drop("_run", "_in")


def read_archives(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """The verified records under ``path``: file, offset, record_type, page_id, url, refers_to, stated_digest, and payload_bytes
    and payload_digest of the payload as read; with ``payloads`` the payload itself (binary) too.

    Magic inside payloads starts no record. A record that its file cuts short is left out. Ids that aren't of ``id_type`` are null.
    """
    found = candidates(spark, path)
    fields = parse(F.col("value"), id_type)
    rows = found.select("file", "block", "place", (F.octet_length("value").cast("long") + len(MAGIC)).alias("size"), *[c.alias(k) for k, c in fields.items()])
    if not payloads:
        rows = _digested(rows)
    placed = with_offsets(cut(rows))
    good = cut(reachable(placed))
    whole = good.where("size >= step")
    shape = [c for c in good.columns if c not in ("block", "place", "size", "step", "successor")]
    torn = good.where("size < step").select("file", F.col("offset").alias("_from"), F.col("successor").alias("_until"))
    if torn.isEmpty():
        return whole.select(*shape)
    # magic inside a payload: put the parts of the record together again
    marks = good.select("file", "offset", F.col("offset").alias("_from"))
    order = Window.partitionBy("file").orderBy("offset")
    owner = placed.select("file", "block", "place", "offset").join(marks, ["file", "offset"], "left")
    owner = owner.withColumn("_from", F.last("_from", ignorenulls=True).over(order)).join(torn, ["file", "_from"]).where("offset < _until")
    parts = owner.join(found, ["file", "block", "place"]).groupBy("file", "_from").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("_parts"))
    joined = parts.select("file", F.col("_from").alias("offset"), F.array_join(F.transform("_parts", lambda x: x["value"]), MAGIC).alias("value"))
    again = joined.select("file", "offset", (F.octet_length("value").cast("long") + len(MAGIC)).alias("size"), *[c.alias(k) for k, c in fields.items()])
    if not payloads:
        again = _digested(again)
    return whole.select(*shape).unionByName(again.where("size >= step").select(*shape))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))}).drop("payload")


def pages_through_archives(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read these back, and return a row per record: page_id, payload_bytes, payload_digest (both of
    the full payload, for a revisit that of the record it refers to), record_type and refers_to.

    Archives stay where ``path`` says; without one they are put into the shared folder and deleted once they are read.
    """
    spark = pages.sparkSession
    place = path or fresh_path(spark, "warc")
    write_archives(describe(pages, min_revisit_bytes=min_revisit_bytes), place)
    read = read_archives(spark, place, id_type=pages.schema["page_id"].dataType.simpleString())
    sound = F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest"))
    corrupt = F.raise_error(F.concat(F.lit("payload without its stated digest: record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    own = read.where("record_type = 'response'").withColumn("payload_digest", F.coalesce(sound, corrupt.cast("string")))
    of = cut(own.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct())
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated_digest")
    again = again.join(of, F.col("refers_to").eqNullSafe(F.col("_id")) & (F.col("stated_digest") == F.col("_digest"))).select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    out = own.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)
    if path is None:
        out = cut(out)
        delete_path(spark, place)
    return out

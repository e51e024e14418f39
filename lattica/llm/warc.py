"""Web archives (WARC 1.1) without repeated payloads: later copies become revisit records of the first one.

Archives are written by Spark's text writer, records apart by the format's own end mark, each file compressed, and read
as a stream of lines put together by their content lengths: no task holds more than one record, and every folder that
Spark reaches will do. A revisit names its payload's digest, by which it is joined to the original response.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n"
#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A record as it is read; a revisit has no payload. payload_bytes and payload_digest are those of the full payload.
RECORD = "page_id long, url string, record_id string, record_type string, date string, payload_bytes long, payload_digest string, refers_to_id string, payload binary, intact boolean"
KINDS = ("response", "resource", "revisit")
#: A payload with over a thousandth of all records is hot: there are fewer than a thousand of these.
HOT = 1000


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32, without a label."""
    raw = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(raw, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def responses(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (the html in UTF-8; null: empty), payload_bytes and payload_digest, for every row.

    Further columns are left out. What a header can't hold in a url, white space and control characters, is
    percent-encoded; a null url stays null.
    """
    url = F.col("url").cast("string")
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest(F.col("payload"))})


def _meet(heads: DataFrame, groups: DataFrame) -> DataFrame:
    """``heads`` left joined by payload_digest with ``groups`` (one row a digest, ``n``: its number of records).

    A hot digest's rows stay where they are and meet a broadcast of the hot ones; each other digest has at most a
    thousandth of all records.
    """
    hot = F.col("n") * HOT > heads.count()
    names = [c for c in groups.columns if c not in ("payload_digest", "n")]
    few = groups.where(hot).drop("n").withColumn("is_hot", F.lit(True))
    marked = heads.join(F.broadcast(few), "payload_digest", "left")  # fewer than HOT rows
    rest = marked.where("is_hot IS NULL").drop("is_hot", *names).join(groups.where(~hot).drop("n"), "payload_digest", "left")
    return marked.where("is_hot").drop("is_hot").unionByName(rest)


def resolve(records: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, payload_digest, payload_bytes, record_type and refers_to of every row of ``records``.

    Of records whose payload has at least ``smallest`` bytes and the same digest, that of the smallest page_id is the
    response; rows that repeat that page_id are responses too. The others are revisits and refer to it. Shorter ones are
    all responses. A null page_id is a revisit of any other; if all are null they are responses. Only headers are shuffled.
    """
    heads = common.written(records.select("page_id", "payload_digest", "payload_bytes"))
    long = heads.where(F.col("payload_bytes") >= smallest)
    groups = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (F.col("payload_bytes") >= smallest) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind = F.when(later, "revisit").otherwise("response")
    return _meet(heads, common.written(groups)).select(*heads.columns, kind.alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))


def deduplicated(records: DataFrame, smallest: int = 0) -> DataFrame:
    """``records`` (as of ``responses``) with record_type and refers_to; revisits without payload.

    Only records that may be revisits are shuffled, by bitmaps of these; all others stay where they are.
    """
    found = resolve(records, smallest).where("record_type = 'revisit'")
    again = common.written(found.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to", F.xxhash64("page_id", "payload_digest").alias("k")).distinct())
    sure, maybe = common.divided(records, F.xxhash64("page_id", "payload_digest"), again.select("k"))
    met = maybe.join(again.drop("k"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    revisit = F.col("d").isNotNull()
    kinds = {"payload": F.when(~revisit, F.col("payload")), "record_type": F.when(revisit, "revisit").otherwise("response")}
    return sure.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).unionByName(met.withColumns(kinds).drop("p", "d"))


def _name(page_id: Column, payload_digest: Column) -> Column:
    """A record's id, from its page and payload."""
    x = F.md5(F.concat_ws(":", page_id.cast("string"), payload_digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _head(fields: list[tuple[str, Column]]) -> Column:
    """Header lines of the fields that aren't null, and the empty line behind them."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in fields), F.lit(END))


def write(records: DataFrame, path: str, date: str = DATE) -> None:
    """Writes ``records`` (as of ``deduplicated``) as archives with fresh headers, one file a task.

    A response holds an HTTP head and the payload, a revisit the head alone, its digest, and the id of the response. The
    HTTP head gives the full payload's length for both. An empty table gives no records.
    """
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}"), _head([("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes"))]))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _name(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _name(F.col("refers_to"), F.col("payload_digest")))),
        ("X-Page-ID", F.col("page_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block")),
    ]
    rows = records.withColumn("block", block)
    record = F.concat(F.lit(VERSION + END), _head(fields), F.col("block"))
    rows.select(record.alias("value")).write.options(compression="gzip", lineSep=END + END).text(path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Names (lower case) and values of header lines; what has no colon is passed over."""
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def _record(head: dict[str, str], block: bytes) -> tuple:
    kind, label = head.get("warc-type"), head.get("warc-payload-digest", "")
    top, _, payload = (b"", b"", block) if kind == "resource" else block.partition(b"\r\n\r\n")
    http = _fields(top.split(b"\r\n")[1:])
    said = label.removeprefix("sha1:") or None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    page = head.get("x-page-id")
    fields = (None if page is None else int(page), head.get("warc-target-uri"), head.get("warc-record-id"), kind, head.get("warc-date"))
    if kind == "revisit":
        size = http.get("content-length", "")
        return *fields, int(size) if size.isdigit() else None, said, head.get("warc-refers-to"), None, True
    return *fields, len(payload), own, None, payload, said in (None, own)


def _parse(batches):
    """Records from lines in file order; ``END`` divides lines, so a block's lines are joined by it again."""
    file, state, need, head, lines, held, out, size = None, "between", 0, [], [], 0, [], 0

    def flush():
        columns = list(zip(*out, strict=True))
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    for batch in batches:
        for name, line in zip(batch.column("file").to_pylist(), batch.column("line"), strict=True):
            line = line.as_buffer().to_pybytes()
            if name != file:
                if state != "between":
                    raise ValueError(f"{file} ends within a record")
                file = name
            if state == "between":
                if line:
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"{file}: a record begins with {line[:40]!r}")
                    state, head = "head", []
            elif state == "head":
                if line:
                    head.append(line)
                    continue
                fields = _fields(head)
                state, need, lines, held = "block", int(fields["content-length"]), [], -2
                if not need:
                    if fields.get("warc-type") in KINDS:
                        out.append(_record(fields, b""))
                    state = "between"
            else:
                lines.append(line)
                held += len(line) + 2
                if held > need:
                    raise ValueError(f"{file}: a block is longer than its header says")
                if held == need:
                    if fields.get("warc-type") in KINDS:
                        out.append(_record(fields, b"\r\n".join(lines)))
                    state, lines = "between", []
                    size += need
            if len(out) >= 4096 or size > 4 << 20:
                yield flush()
                out.clear()
                size = 0
    if state != "between":
        raise ValueError(f"{file} ends within a record")
    if out:
        yield flush()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path`` (gzip or plain): see ``RECORD``; other types of record are passed over.

    ``intact``: a response's payload has the digest that its header states. Archives that end within a record or whose
    lengths are wrong raise an error. A compressed file isn't split: a task reads it from its first line to its last. Plain
    files may have up to ``spark.sql.files.maxPartitionBytes``, beyond which a split would raise the error.
    """
    text = spark.read.options(lineSep=END, recursiveFileLookup="true").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    records = lines.mapInArrow(_parse, RECORD)
    return records if payloads else records.drop("payload")


def joined(records: DataFrame) -> DataFrame:
    """``records`` (as of ``read``) without payloads, with refers_to: for revisits, the page_id of the original response.

    Revisits meet responses by payload digest; a length that a revisit doesn't state comes from its response. A revisit
    whose original isn't there refers to null; of several responses with one digest the smallest page_id counts.
    """
    heads = common.written(records.drop("payload"))
    response = F.col("record_type") != "revisit"
    first, full = F.min(F.when(response, F.col("page_id"))), F.max(F.when(response, F.col("payload_bytes")))
    groups = heads.groupBy("payload_digest").agg(first.alias("first"), full.alias("full"), F.count(F.lit(1)).alias("n"), F.count_if(~response).alias("revisits"))
    met = _meet(heads, common.written(groups.where("revisits > 0").drop("revisits")))
    return met.withColumns({"refers_to": F.when(~response, F.col("first")), "payload_bytes": F.coalesce("payload_bytes", "full")}).drop("first", "full")


def rewrite(spark: SparkSession, source: str, target: str, smallest: int = 0, date: str = DATE) -> None:
    """Archives under ``source`` written to ``target`` without repeated payloads, their revisits tied to the originals.

    Revisits in the source whose original isn't there are kept as revisits that refer to nothing.
    """
    records, keep = common.written(read(spark, source)), ["page_id", "url", "payload_bytes", "payload_digest"]
    there = records.where("record_type <> 'revisit'").select(*keep, F.col("payload").cast("string").alias("payload"))
    old = joined(records).where("record_type = 'revisit'").select(*keep, F.lit(None).cast("string").alias("payload"), "record_type", "refers_to")
    write(deduplicated(there, smallest).unionByName(old), target, date)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark)
    write(deduplicated(responses(common.spread(common.table(spark, sf_dir, "pages")))), path)
    return joined(read(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), pages_ AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    list_reduce(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[10 * (k // 8) + 1:10 * (k // 8) + 10])::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1]), lambda a, b: a || b) AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM pages_
"""

"""WARC archives, index first.

Writing: every task writes its rows as records (a gzip member each) to a file of
its own in the shared folder and returns one index row per record: file, offset,
length, url, digest.  Names are unique per attempt, and only index rows of
attempts that succeeded are kept, so a lost executor leaves at most a file that
nothing points to.  Of equal payloads the row with the least id (then the least
url) is a response, the others are revisit records that refer to it.  Rows equal
to it in id and url, too, are counted where they lie: one of them is the response.

Reading: index rows are chosen first; per file and stretch they are sorted by
offset, and ranges with small gaps are read in one go.

Defined results: a null page has an empty payload; of rows that repeat the least
id of their payload one is the response, the others revisit that id; rows without an id refer to the least known
id of their payload, or are responses if there is none; urls are written with
control characters and blanks percent-encoded, a null one as `about:blank`; an
empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from typing import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_dir, small_batches

GAP = 64 * 1024
MOST = 8 * 1024 * 1024
STRETCH = 32 * 1024 * 1024
BROADCAST = 200_000
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit has HTTP headers but no payload."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}<>\"\\") if url else "about:blank"
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html with refers_to: null for responses."""
    rows = pages.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    alike = rows.where("page_id is not null").groupBy("sha", "page_id", "url").agg(F.count("*").alias("n"))
    # the least row of each payload: by id, then by url, null last
    least = alike.groupBy("sha").agg(F.min(F.struct("page_id", F.col("url").isNull().alias("no_url"), "url", "n")).alias("l"), F.sum("n").alias("known"))
    total = rows.groupBy("sha").agg(F.count("*").alias("n"))
    twice = total.where("n > 1").join(least, "sha").select("sha", F.col("l.page_id").alias("least"), F.col("l.url").alias("least_url"), F.col("l.n").alias("same"), "n")
    twice = materialise(twice, "warc-twice")
    if twice.limit(BROADCAST + 1).count() <= BROADCAST:
        told = rows.join(F.broadcast(twice.drop("n")), "sha", "left")
    else:
        told = lookup(rows, twice, ["sha"], "n")
    first = F.coalesce((F.col("page_id") == F.col("least")) & F.col("url").eqNullSafe(F.col("least_url")), F.lit(False))
    out = ["page_id", "url", "html", "refers_to"]
    told = told.withColumn("refers_to", F.when(~first, F.col("least")))
    if twice.where("same > 1").isEmpty():
        return told.select(*out)
    repeats = first & (F.col("same") > 1)
    one = told.where(repeats).groupBy("sha", "page_id", "url").agg(F.first("html").alias("html"), F.count("*").alias("c"))
    one = one.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).withColumn("refers_to", F.when(F.col("i") > 1, F.col("page_id")))
    return told.where(~F.coalesce(repeats, F.lit(False))).select(*out).unionByName(one.select(*out))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write the archives and return their index, itself a written table."""
    small_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for part in parts:
                index = []
                for page_id, url, page, refers in part.itertuples(index=False):
                    own = None if pd.isna(page_id) else int(page_id)
                    to = None if pd.isna(refers) else int(refers)
                    payload = (page if isinstance(page, str) else "").encode("utf-8")
                    digest = base32_sha1(payload)
                    press = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = press.compress(record(own, url if isinstance(url, str) else None, payload, digest, to)) + press.flush()
                    out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(raw)
                    index.append((own, url, name, at, len(raw), digest, len(payload), "response" if to is None else "revisit", to))
                    at += len(raw)
                frame = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out:
                out.close()

    index = _roles(slim).mapInPandas(run, INDEX)
    return materialise(index.withColumn("folder", F.lit(folder)), "warc-index")


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int]]:
    """(offset, end, how many spans) of the reads that cover sorted (offset, length) spans."""
    out: list[tuple[int, int, int]] = []
    for offset, length in spans:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2] + 1)
        else:
            out.append((offset, offset + length, 1))
    return out


def read(index: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of the index rows given, from the archives.

    The digest of a response is computed from what was read and must be that of
    the index; a revisit carries its payload's digest and length in its headers.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handle, opened = None, None
        for part in parts:
            rows = []
            for (folder, file), own in part.groupby(["folder", "file"], sort=False):
                if opened != (folder, file):
                    system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                    handle, opened = system.open_input_file(f"{base}/{file}"), (folder, file)
                own = own.sort_values("offset", kind="stable")
                spans = list(zip(own["offset"].tolist(), own["length"].tolist(), strict=True))
                urls, digests, at = own["url"].tolist(), own["payload_digest"].tolist(), 0
                for start, end, n in ranges(spans):
                    block = handle.read_at(end - start, start)
                    for k in range(at, at + n):
                        offset, length = spans[k]
                        headers, payload = parse(zlib.decompress(block[offset - start : offset - start + length], 31))
                        digest, to = headers["warc-payload-digest"].removeprefix("sha1:"), headers.get("x-refers-to")
                        if to is None:
                            digest = base32_sha1(payload)
                        if digest != digests[k]:
                            raise ValueError(f"{file} at {offset}: payload of another digest")
                        size = len(payload) if to is None else int(headers["x-payload-length"])
                        rows.append((int(headers["x-page-id"]) if headers["x-page-id"] else None, urls[k], payload.decode("utf-8") if to is None else None, size, digest, headers["warc-type"], int(to) if to else None))
                    at += n
            frame = pd.DataFrame(rows, columns=["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    chosen = index.withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    chosen = chosen.repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return chosen.select("folder", "file", "offset", "length", "url", "payload_digest").mapInPandas(run, "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, id_col, url_col, html_col)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



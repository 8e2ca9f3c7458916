"""WARC archives and an external merge of their indexes.

Each task writes gzipped records to archives in a shared folder and, beside each archive, a run: its index rows sorted by URL key,
time and page, in blocks. Loser trees merge the runs, ``FAN`` at once and level by level; at each level the work is cut at block
borders into ranges of the keys, and a task streams the blocks that a range touches. The last level's ranges, one after another,
are the capture histories in global order, and each capture's place in them is known.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, new_path, written

LEVEL, ARCHIVE_BYTES = 1, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Runs that one tree merges; index rows in a block; blocks that a task's range holds, about.
FAN, BLOCK_ROWS, RANGE_BLOCKS = 64, 1024, 256
_KEY = "url_key string, captured_at long, page long"
_BLOCKS = f"run string, file string, block int, n long, first struct<{_KEY}>, last struct<{_KEY}>, part long"
_ROWS = pa.schema([("url_key", pa.string()), ("captured_at", pa.int64()), ("page", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
#: A page_id that is null sorts before all others.
NO_PAGE = -(2**63)


def shared(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a path or as a URI with any number of slashes."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), folder
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(folder)


def url_key(url: str | None) -> str:
    """A URL with its host's labels reversed, so that a site's captures sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = ",".join(reversed((parts.hostname or "").split("."))), parts.port
    except ValueError:
        return (url or "").lower()
    at = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{host}{at}){parts.path.lower() or '/'}" + f"?{parts.query.lower()}" * bool(parts.query)


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, captured_at: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response, or a revisit with the response's HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}"]
    lines.append(f"WARC-Date: {datetime.fromtimestamp(captured_at, UTC):%Y-%m-%dT%H:%M:%SZ}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header fields, HTTP head and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/") or rest[int(fields["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def merge(runs: Iterable[Iterable]) -> Iterator:
    """Sorted runs as one, by a loser tree: each step replays the path from the winner's leaf to the root. Runs are read as they are used up."""
    streams = [iter(run) for run in runs]
    k, end = len(streams), (1,)
    if not k:
        return
    heads: list[tuple] = [next(((0, x) for x in stream), end) for stream in streams]
    losers: list[int] = [-1] * k

    def play(i: int) -> int:
        """Carry run i up; losers stay behind. While the tree fills, the first to come waits."""
        node = (i + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = i
                return -1
            if heads[losers[node]] < heads[i]:
                losers[node], i = i, losers[node]
            node //= 2
        return i

    winner = -1
    for i in range(k):
        if (found := play(i)) >= 0:
            winner = found
    while heads[winner] != end:
        yield heads[winner][1]
        heads[winner] = next(((0, x) for x in streams[winner]), end)
        winner = play(winner)


class RunWriter:
    """Writes sorted index rows as a file of blocks, and tells each block's first and last key."""

    def __init__(self, folder: str, run: str, block_rows: int = BLOCK_ROWS):
        store, root = shared(folder)
        self.file, self.run, self.rows, self.blocks, self.most = f"{uuid.uuid4().hex}.run", run, [], [], block_rows
        self.out = store.open_output_stream(f"{root}/{self.file}", compression=None)
        self.writer = ipc.new_file(self.out, _ROWS)

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == self.most:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _ROWS, strict=True)], schema=_ROWS))
            keys = [dict(zip(("url_key", "captured_at", "page"), row[:3], strict=True)) for row in (self.rows[0], self.rows[-1])]
            self.blocks.append((self.run, self.file, len(self.blocks), len(self.rows), *keys))
            self.rows = []

    def close(self, part: int = 0) -> pd.DataFrame:
        self._flush()
        self.writer.close()
        self.out.close()
        return pd.DataFrame(self.blocks, columns=["run", "file", "block", "n", "first", "last"]).assign(part=part)


def read_blocks(folder: str, blocks: Iterable[tuple[str, int]]) -> Iterator[tuple]:
    """Index rows of (file, block) pairs; one block and one open file at a time."""
    store, root = shared(folder)
    name, reader, source = None, None, None
    for file, block in blocks:
        if file != name:
            if source is not None:
                source.close()
            name, source = file, store.open_input_file(f"{root}/{file}")
            reader = ipc.open_file(source)
        yield from zip(*[c.to_pylist() for c in reader.get_batch(block).columns], strict=True)
    if source is not None:
        source.close()


def _write(batches: Iterator[pd.DataFrame], folder: str, archive_bytes: int, block_rows: int) -> Iterator[pd.DataFrame]:
    store, root = shared(folder)
    out, rows, size = None, [], 0

    def close() -> pd.DataFrame:
        out.close()
        run = RunWriter(folder, name, block_rows)
        for row in sorted(rows):
            run.add(row)
        return run.close()

    for batch in batches:
        for page, url, html, keep, at in zip(batch["page_id"].astype(object), batch["url"], batch["html"], batch["keep"].astype(object), batch["captured_at"], strict=True):
            page, keep = (None if x is None or x != x else int(x) for x in (page, keep))
            if out is None:
                name, rows, size = f"{uuid.uuid4().hex}.warc.gz", [], 0  # a repeated task writes other files; only the runs that are kept name some
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = pack.compress(record(page, url, int(at), (html or "").encode(), None if keep == page else keep)) + pack.flush()
            out.write(data)
            rows.append((url_key(url), int(at), NO_PAGE if page is None else page, name, size, len(data)))
            size += len(data)
            if size > archive_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured_at: str | None = None, archive_bytes: int = ARCHIVE_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write a record for each row, and return the blocks of the archives' sorted index runs: ``run``, ``file``, ``block``, ``n``, ``first``, ``last``, ``part``.

    Of equal payloads (null: empty), that with the largest page_id is a response and the others revisit it; rows without page_id revisit
    others but are revisited by none. ``captured_at``: a column of seconds since 1970; without one, page_id counts. ``folder``, a path or a
    URI, must be shared by all machines and reachable through pyarrow's file systems. A task holds the index rows of one archive.
    """
    time = F.col(captured_at).cast("long") if captured_at else F.pmod(F.col(page_id).cast("long"), F.lit(4_000_000_000))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.coalesce(time, F.lit(0)).alias("captured_at"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("sha1"))
    keep = rows.groupBy("sha1").agg(F.max("page_id").alias("keep"))
    store, root = shared(folder)
    store.create_dir(root, recursive=True)
    blocks = join_hot(rows, keep, ["sha1"]).select("page_id", "url", "html", "keep", "captured_at").mapInPandas(lambda b: _write(b, folder, archive_bytes, block_rows), _BLOCKS)
    return written(blocks, "runs")


def _merge_ranges(batches: Iterator[pd.DataFrame], folder: str, block_rows: int) -> Iterator[pd.DataFrame]:
    """Each row is a range of the keys with the blocks it touches; its rows are merged into a file of their own."""
    for batch in batches:
        for group, part, lo, hi, blocks in zip(batch["group"], batch["part"], batch["lo"], batch["hi"], batch["blocks"], strict=True):
            low, high = (None if x is None else (x["url_key"], x["captured_at"], x["page"]) for x in (lo, hi))
            runs: dict[str, list] = {}
            for x in blocks:  # sorted by run, part and block
                runs.setdefault(x["run"], []).append((x["file"], x["block"]))
            inside = lambda rows, low=low, high=high: (r for r in rows if (low is None or r[:3] >= low) and (high is None or r[:3] < high))
            out = RunWriter(folder, f"{group}", block_rows)
            for row in merge(inside(read_blocks(folder, b)) for b in runs.values()):
                out.add(row)
            yield out.close(part)


def merge_runs(blocks: DataFrame, folder: str, groups: DataFrame, range_blocks: int = RANGE_BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge each group's runs into one. groups: ``run``, ``group``. Returns blocks; ``part`` is now the range of the group that they are from.

    Ranges are cut at every ``range_blocks``-th block's first key, so a range holds about as many blocks and at most one more from
    each run. The window that cuts them sees a row per block, never index rows.
    """
    own = Window.partitionBy("group").orderBy("key", "last_of", "run", "at", "file", "block")
    rows = blocks.withColumnRenamed("part", "at").join(groups, "run")
    firsts = rows.select("group", "run", "at", "file", "block", F.col("first").alias("key"), F.lit(False).alias("last_of"))
    lasts = rows.select("group", "run", "at", "file", "block", F.col("last").alias("key"), F.lit(True).alias("last_of"))
    # of the marks in order of their keys, those of firsts are counted: a block reaches from its first key's range to its last key's
    rank = F.sum((~F.col("last_of")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1
    marks = firsts.union(lasts).withColumn("rank", rank).withColumn("part", F.floor(F.col("rank") / range_blocks).cast("long"))
    cuts = marks.where(f"NOT last_of AND rank % {range_blocks} = 0").select("group", "part", "key")
    cuts = cuts.withColumn("hi", F.lead("key").over(Window.partitionBy("group").orderBy("part"))).select("group", "part", F.when(F.col("part") > 0, F.col("key")).alias("lo"), "hi")
    spans = marks.groupBy("group", "run", "at", "file", "block").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    touched = spans.select("group", "run", "at", "file", "block", F.explode(F.sequence("a", "b")).alias("part"))
    jobs = touched.groupBy("group", "part").agg(F.sort_array(F.collect_list(F.struct("run", "at", "block", "file"))).alias("blocks")).join(cuts, ["group", "part"])
    jobs = jobs.repartition(max(1, blocks.sparkSession.sparkContext.defaultParallelism), "group", "part")
    return written(jobs.select("group", "part", "lo", "hi", "blocks").mapInPandas(lambda b: _merge_ranges(b, folder, block_rows), _BLOCKS), "runs")


def capture_history(blocks: DataFrame, folder: str, fan: int = FAN, range_blocks: int = RANGE_BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the one run that all runs are merged into, ``fan`` at a time; ``start`` is the place of a block's first row in the history."""
    while True:
        runs = blocks.select("run").distinct()
        n = runs.count()
        last = n <= fan
        # groups of about half the fan by hash, so that hardly any exceeds it; a larger one is merged all the same
        number = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("run"), F.lit(-(-n // max(1, fan // 2))))
        blocks = merge_runs(blocks, folder, runs.withColumn("group", number), range_blocks, block_rows)
        if last:
            break
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("rows"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(before().orderBy("part")), F.lit(0)).alias("base"))
    place = F.coalesce(F.sum("n").over(before("part").orderBy("block")), F.lit(0))
    return blocks.withColumn("place", place).join(starts, "part").select("file", "block", "n", (F.col("base") + F.col("place")).alias("start"))


def _captures(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, block, start in zip(batch["file"], batch["block"].tolist(), batch["start"].tolist(), strict=True):
            rows = list(read_blocks(folder, [(file, block)]))
            out = pd.DataFrame(rows, columns=_ROWS.names)
            page = out.pop("page")
            yield out.assign(page_id=page.astype("Int64").where(page != NO_PAGE), position=range(start, start + len(rows)))


def captures(history: DataFrame, folder: str) -> DataFrame:
    """The index rows of a history with their ``position`` in it, from 0."""
    schema = "url_key string, captured_at long, archive string, offset long, length long, page_id long, position long"
    return history.mapInPandas(lambda b: _captures(b, folder), schema)


def _read(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    store, root = shared(folder)
    name, file = None, None
    for batch in batches:
        rows = []
        for key, at, place, archive, offset, length in zip(*[batch[c].tolist() for c in ("url_key", "captured_at", "position", "archive", "offset", "length")], strict=True):
            if archive != name:
                name, file = archive, store.open_input_file(f"{root}/{archive}")
            file.seek(offset)
            fields, http, payload = parse(zlib.decompress(file.read(length), 31))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(http.rpartition(b"Content-Length: ")[2])
            if kind == "response" and (size != len(payload) or digest != base32_sha1(payload)):
                raise ValueError(f"{archive} is damaged at {offset}")
            rows.append((key, at, place, _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, _number(fields.get("WARC-Refers-To")), payload.decode() if kind == "response" else None))
        yield pd.DataFrame(rows, columns=["url_key", "captured_at", "position", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(found: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``captures`` names, read back and checked against their digests; an archive's are read in the order they stand in.

    Each keeps its ``position``, so the histories' order is in the result however it is read.
    """
    schema = "url_key string, captured_at long, position long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    take = (lambda b: _read(b, folder)) if payloads else lambda b: (x.drop(columns="html") for x in _read(b, folder))
    return found.repartition("archive", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "offset").mapInPandas(take, schema + ", html string" * payloads)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as WARC, merge the indexes into capture histories, and read back every capture.

    Per row of ``pages``: ``page_id``, ``payload_bytes``, ``payload_digest`` (bare base32 SHA-1), ``record_type``, ``refers_to``, ``url_key``,
    ``captured_at``, ``position`` (place in the global order of URL key, time and page, from 0). Null html is an empty payload, a null url has
    no target and an empty host in its key. Repeated rows are written again; other columns are ignored; an empty table gives no rows.
    The archives stay in ``folder``.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    history = capture_history(write_archives(pages, folder), folder)
    found = read_archives(captures(history, folder), folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")

"""MPEG transport streams as media columns: write, parse, check and reassemble."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: packet size, sync byte, packet ids, stream type and id, clock rate.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID, PROGRAM = 0x06, 0xBD, 1
CLOCK = 90_000
#: Bytes of an access unit, clock ticks between units, and units between random-access points.
UNIT, TICKS, RANDOM_EVERY = 16_384, 3_600, 4
PTS_MOD = 1 << 33


def _crc_table() -> list[int]:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first."""
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _table_packet(pid: int, section: bytes, count: int) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | count & 15) + b"\0" + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def write_stream(payload: bytes) -> bytes:
    """Payload bytes as a transport stream of one program with one private elementary stream.

    Each access unit is one elementary packet with a timestamp. Every ``RANDOM_EVERY``-th starts
    with the program tables and a clock reference and is marked for random access.
    """
    out, count, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts, random = payload[at : at + UNIT], number * TICKS % PTS_MOD, number % RANDOM_EVERY == 0
        if random:
            out += (_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables))
            tables += 1
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(unit) + 8, 0x80, 0x80, 5) + _pts_bytes(pts) + unit
        field = struct.pack(">BIH", 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00) if random else b""
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        if len(pes) < room:  # stuffing fills the field up
            field = (field or b"\0" * (room - len(pes) > 1)) + b"\xff" * (room - len(pes) - (0 if field else 1 + (room - len(pes) > 1)))
            first = struct.pack(">BHBB", SYNC, 0x4000 | ES_PID, 0x30 | count, len(field)) + field + pes
            room = len(pes)
        elif field:
            first = struct.pack(">BHBB", SYNC, 0x4000 | ES_PID, 0x30 | count, len(field)) + field + pes[:room]
        else:
            first = struct.pack(">BHB", SYNC, 0x4000 | ES_PID, 0x10 | count) + pes[:room]
        out.append(first)
        count = (count + 1) & 15
        full, rest = divmod(len(pes) - room, PACKET - 4)
        if full:
            body = np.empty((full, PACKET), np.uint8)
            body[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 0xFF)
            body[:, 3] = 0x10 | (count + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, -1)
            out.append(body.tobytes())
            count = (count + full) & 15
        if rest:
            spare = PACKET - 5 - rest
            field = b"\0" + b"\xff" * (spare - 1) if spare else b""
            out.append(struct.pack(">BHBB", SYNC, ES_PID, 0x30 | count, spare) + field + pes[-rest:])
            count = (count + 1) & 15
    return b"".join(out)


def read_stream(media: bytes) -> dict:
    """Parse a transport stream by its own tables; raises ValueError where it is broken.

    The first program is read; an entry for the network before it is passed over. A packet that repeats the one before it of its
    stream, as the format allows, counts once, and where a packet says that its counter jumps, that is no gap. Returns ``payload``, ``units`` (timestamp, offset, length, random access), ``program``,
    ``table_pid``, ``stream_pid``, ``packets`` and ``gaps`` (continuity errors).
    """
    if len(media) % PACKET or not media:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any() or (packets[:, 1] & 0x80).any():
        raise ValueError("lost sync or marked as damaged")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    control, counts = packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    offsets = np.where(control & 2, 5 + packets[:, 4].astype(np.int32), 4)

    def section(pid: int) -> bytes:
        found = None
        for i in np.flatnonzero((pids == pid) & (packets[:, 1] & 0x40 > 0)):
            raw = packets[i, offsets[i] :].tobytes()
            raw = raw[1 + raw[0] :]
            if raw == found:
                continue
            found = found or raw
            size = 3 + (struct.unpack_from(">H", raw, 1)[0] & 0xFFF)
            if raw != found or crc32_mpeg(raw[:size]) != 0:
                raise ValueError("a program table is damaged or changes")
        if found is None:
            raise ValueError("a program table is missing")
        return found[8 : 3 + (struct.unpack_from(">H", found, 1)[0] & 0xFFF) - 4]

    listed = section(PAT_PID)
    entries = [struct.unpack_from(">HH", listed, i) for i in range(0, len(listed) - 3, 4)]
    program, table = next(((n, pid & 0x1FFF) for n, pid in entries if n), (0, 0))  # number 0 names the network's table
    if not program:
        raise ValueError("a program table is missing")
    body = section(table)
    at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
    stream = struct.unpack_from(">H", body, at + 1)[0] & 0x1FFF
    jumps = (control & 2 > 0) & (packets[:, 4] > 0) & (packets[:, 5] & 0x80 > 0)

    def once(pid: int) -> tuple[np.ndarray, int]:
        """The packets of a stream that hold data, without repeated ones, and how often its counter is broken."""
        at = np.flatnonzero((pids == pid) & (control & 1 > 0))
        same = np.flatnonzero(counts[at[1:]] == counts[at[:-1]]) + 1
        again = [i for i in same if packets[at[i], offsets[at[i]] :].tobytes() == packets[at[i - 1], offsets[at[i - 1]] :].tobytes()]
        at = np.delete(at, again)
        return at, int(((np.diff(counts[at].astype(np.int16)) % 16 != 1) & ~jumps[at[1:]]).sum())

    gaps = sum(once(pid)[1] for pid in (PAT_PID, table))
    rows, broken = once(stream)
    gaps += broken
    es, begin = packets[rows], offsets[rows]
    data = es[np.arange(PACKET) >= begin[:, None]].tobytes()
    starts = np.flatnonzero(es[:, 1] & 0x40)
    ends = np.concatenate(([0], np.cumsum(PACKET - begin)))
    random = (control[rows] & 2 > 0) & (es[:, 4] > 0) & (es[:, 5] & 0x40 > 0)
    parts, units, size = [], [], 0
    for i, nxt in zip(starts, [*starts[1:], len(rows)], strict=True):
        pes = data[ends[i] : ends[nxt]]
        code, length, _, flags, extra = struct.unpack_from(">IHBBB", pes)
        if code != 0x100 | STREAM_ID or length != len(pes) - 6 or not flags & 0x80:
            raise ValueError("an elementary packet is damaged")
        a, b, c = struct.unpack_from(">BHH", pes, 9)
        parts.append(pes[9 + extra :])
        units.append(((a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1, size, len(parts[-1]), bool(random[i])))
        size += len(parts[-1])
    return {
        "payload": b"".join(parts), "units": units, "program": program, "table_pid": table, "stream_pid": stream,
        "packets": len(packets), "gaps": gaps,
    }


def padded(text: str | None) -> bytes:
    """UTF-8 bytes, with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def _mapped(df: DataFrame, of: str, to: list[tuple[str, pa.DataType]], ddl: str, make) -> DataFrame:
    """``df`` with the columns ``to`` made from each value of column ``of``, which goes."""
    rest = [c for c in df.columns if c != of and c not in {n for n, _ in to}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, column = max(1, min(1000, 1 + batch.num_rows * (16 << 20) // (batch.nbytes + 1))), batch.column(of)
            for i in range(0, batch.num_rows, step):
                made = [make(x.as_py()) for x in column.slice(i, step)]
                new = [pa.array([m[k] for m in made], t) for k, (_, t) in enumerate(to)]
                old = [batch.column(c).slice(i, step) for c in rest]
                yield pa.RecordBatch.from_arrays(old + new, rest + [n for n, _ in to])

    return df.select(*rest, of).mapInArrow(run, ", ".join(x for x in (schema, ddl) if x))


def text_to_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media`` (binary, a transport stream of the padded text) in place of ``text``.

    Null and empty text give a stream of 64 zero bytes. A column ``media`` of ``docs`` is replaced.
    Equal texts give equal streams. An empty table gives an empty table.
    """
    return _mapped(docs, text, [("media", pa.binary())], "media binary", lambda x: (write_stream(padded(x)),))


_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))


def read_streams(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` with the stream of ``media`` parsed: ``payload``, ``units`` (timestamp, place in the payload,
    random-access point), ``program``, ``stream_pid``, ``packets`` and ``gaps`` in place of it, and ``broken``:
    what is wrong with a stream that cannot be read (null media too), whose other columns are null."""

    def parse(x: bytes | None):
        try:
            r = read_stream(x or b"")
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, None, None, None, str(e)
        units = [dict(zip(("pts", "start", "size", "random_access"), u, strict=True)) for u in r["units"]]
        return r["payload"], units, r["program"], r["stream_pid"], r["packets"], r["gaps"], None

    to = [("payload", pa.binary()), ("units", _UNITS), ("program", pa.int32()), ("stream_pid", pa.int32()), ("packets", pa.int64()), ("gaps", pa.int64()), ("broken", pa.string())]
    ddl = "payload binary, units array<struct<pts:bigint,start:bigint,size:bigint,random_access:boolean>>, program int, stream_pid int, packets bigint, gaps bigint, broken string"
    return _mapped(table, media, to, ddl, parse)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read it back, and give the digests of both."""
    kept = F.coalesce(F.col("text"), F.lit(""))
    stored = text_to_stream(docs.select("doc_id", F.octet_length(kept).cast("long").alias("n_bytes"), "text"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = read_streams(stored)
    points = F.filter("units", lambda u: u["random_access"])
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        "media_bytes", "media_sha256",
        F.when(F.col("broken").isNotNull(), F.col("broken")).otherwise(F.format_string(
            "pid=%d packets=%d gaps=%d units=%d random=%s last=%d",
            F.col("stream_pid"), F.col("packets"), F.col("gaps"), F.size("units"),
            F.array_join(F.transform(points, lambda u: u["pts"].cast("string")), ","), F.element_at("units", -1)["pts"],
        )).alias("feature"),
    )

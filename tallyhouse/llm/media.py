"""Texts as MPEG transport streams, and what a reader finds in such streams.

``write_ts`` stores a payload as the samples of one private elementary stream:
access units of 1,920 one-byte samples (40 ms at 48 kHz), each in one PES packet
with a presentation timestamp, cut into 188-byte transport packets.  Every
eighth access unit is a random-access point and is preceded by the program
association table and the program map table.  ``read_ts`` knows nothing of that
layout: it follows the program tables (with their CRC), checks the continuity
counters, reassembles the PES packets and collects timestamps.

Defined results: a null text is empty; a payload is padded with spaces to a
positive multiple of 192 bytes; a stream that breaks the format has the reason
in ``error`` and a null payload; equal texts give equal bytes; of several programs the one
with the lowest number is read, and of it the first stream; repeated rows each get a row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PACKET, UNIT, AU_UNITS, RAP_EVERY, ROWS = 188, 192, 10, 8, 256
AU = UNIT * AU_UNITS
PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, PRIVATE_TYPE = 0, 0x1000, 0x0100, 0xBD, 0x06
FIRST_PTS, AU_TICKS, PCR_LEAD = 90_000, 3_600, 9_000


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _psi(pid: int, counter: int, section: bytes) -> bytes:
    return struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10 | counter, 0) + section + b"\xff" * (PACKET - 5 - len(section))


def _stamp(ticks: int) -> bytes:
    return bytes((0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 1 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 1 | ticks << 1 & 0xFE))


def _access_unit(index: int, size: int, counter: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Packets of one access unit with zeros for samples, and where in each its samples go."""
    pts = FIRST_PTS + index * AU_TICKS
    pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, size + 8, 0x84, 0x80, 5) + _stamp(pts)
    pcr = (pts - PCR_LEAD) << 15 | 0x7E00
    field = bytes((7, 0x10 | 0x40 * (index % RAP_EVERY == 0))) + pcr.to_bytes(6, "big")
    packets, places, left = [], [], size
    while left or pes:
        room = PACKET - 4 - len(field)
        if (short := room - len(pes) - left) > 0:  # stuffing goes into the adaptation field
            if not field:
                field = b"\0" if short == 1 else bytes((short - 1, 0)) + b"\xff" * (short - 2)
            else:
                field = bytes((field[0] + short,)) + field[1:] + b"\xff" * short
        take = min(left, PACKET - 4 - len(field) - len(pes))
        head = struct.pack(">BHB", 0x47, 0x4000 * bool(pes) | ES_PID, (0x30 if field else 0x10) | counter % 16) + field + pes
        places.append(np.arange(len(head), len(head) + take))
        packets.append(head + bytes(take))
        left, counter, field, pes = left - take, counter + 1, b"", b""
    return packets, places


def _build(units: int) -> tuple[np.ndarray, np.ndarray]:
    out, where, counter, psi = [], [], 0, 0
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_TYPE, 0xE000 | ES_PID, 0xF000))
    for index in range(-(-units // AU_UNITS)):
        if index % RAP_EVERY == 0:
            out += [_psi(PAT_PID, psi % 16, pat), _psi(PMT_PID, psi % 16, pmt)]
            psi += 1
        packets, places = _access_unit(index, min(AU, (units - index * AU_UNITS) * UNIT), counter)
        counter += len(packets)
        where += [p + PACKET * (len(out) + i) for i, p in enumerate(places)]
        out += packets
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate(where)


_cached = lru_cache(maxsize=128)(_build)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a positive multiple of 192."""
    units = len(payload) // UNIT
    frame, where = _cached(units) if units <= 256 else _build(units)
    stream = frame.copy()
    stream[where] = np.frombuffer(payload, np.uint8)
    return stream.tobytes()


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4] if raw[3] & 0x20 else 4
    at += 1 + raw[at]  # the pointer field
    size = (raw[at + 1] & 0x0F) << 8 | raw[at + 2]
    section = raw[at : at + 3 + size]
    if section[:1] != bytes((table_id,)) or crc32_mpeg(section):
        raise ValueError("program table is damaged")
    return section[8:-4]


def demux(stream: bytes) -> dict:
    """What a transport stream holds: its programs' tables, payload, timestamps and random-access points."""
    if not stream or len(stream) % PACKET:
        raise ValueError("length is no multiple of 188")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("sync byte is missing")
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    if not len(pat := np.flatnonzero((pid == PAT_PID) & starts)):
        raise ValueError("no program association table")
    body = _read_section(p[pat[0]], 0)
    programs = {n: x & 0x1FFF for n, x in struct.iter_unpack(">HH", body) if n}
    if not programs:
        raise ValueError("no program")
    pmt_pid = programs[min(programs)]
    if not len(pmt := np.flatnonzero((pid == pmt_pid) & starts)):
        raise ValueError("no program map table")
    body = _read_section(p[pmt[0]], 2)
    at = 4 + ((body[2] & 0x0F) << 8 | body[3])
    kind, es_pid = body[at], (body[at + 1] << 8 | body[at + 2]) & 0x1FFF
    errors = 0
    for one in {PAT_PID, pmt_pid, es_pid}:  # the counter of each PID goes up with every packet that has a payload
        counter = p[(pid == one) & ((p[:, 3] & 0x10) != 0), 3] & 0x0F
        errors += int(((np.diff(counter.astype(np.int8)) & 0x0F) != 1).sum())
    own = np.flatnonzero((pid == es_pid) & ((p[:, 3] & 0x10) != 0))
    es = p[own]
    has_field = (es[:, 3] & 0x20) != 0
    skip = 4 + np.where(has_field, es[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(has_field & (es[:, 4] > 0), es[:, 5], 0)
    data = es[np.arange(PACKET) >= skip[:, None]]
    begins = np.concatenate([[0], np.cumsum(PACKET - skip)])[:-1][starts[own]]
    if not len(begins) or begins[0] or len(data) - begins[-1] < 14:
        raise ValueError("no elementary packet starts the stream")
    head = data[begins[:, None] + np.arange(14)].astype(np.int64)
    if (head[:, :3] != (0, 0, 1)).any() or (head[:, 7] & 0x80 == 0).any():
        raise ValueError("elementary packet without start code or timestamp")
    sizes = np.diff(np.append(begins, len(data)))
    if ((head[:, 4] << 8 | head[:, 5]) + 6 != sizes).any():
        raise ValueError("elementary packet is cut")
    pts = (head[:, 9] & 0x0E) << 29 | head[:, 10] << 22 | (head[:, 11] & 0xFE) << 14 | head[:, 12] << 7 | head[:, 13] >> 1
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + 9 + head[:, 8], -1)
    payload = data[np.cumsum(edge[:-1]) == 0]
    random = (flags & 0x40) != 0
    rap_packets = own[random & starts[own]]
    rap_pts = pts[random[starts[own]]]
    return {
        "payload": payload.tobytes(), "pmt_pid": pmt_pid, "es_pid": es_pid, "stream_type": kind, "packets": len(p), "continuity_errors": errors, "clock_references": int(((flags & 0x10) != 0).sum()),
        "pts": pts.tolist(), "random_access": [{"pts": int(t), "byte": int(k) * PACKET} for t, k in zip(rap_pts, rap_packets, strict=True)], "error": None,
    }


READ = T.StructType(
    [T.StructField("payload", T.BinaryType())]
    + [T.StructField(x, T.IntegerType()) for x in ("pmt_pid", "es_pid", "stream_type")]
    + [T.StructField(x, T.LongType()) for x in ("packets", "continuity_errors", "clock_references")]
    + [T.StructField("pts", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("byte", T.LongType())]))), T.StructField("error", T.StringType())]
)
FIELDS = READ.names


@F.pandas_udf(T.BinaryType())
def write_ts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([mux(padded(x)) for x in batch], dtype=object)


def _demux(stream: bytes | None) -> dict:
    try:
        return demux(stream or b"")
    except (ValueError, IndexError, struct.error) as why:
        return dict.fromkeys(FIELDS) | {"error": str(why)}


@F.pandas_udf(READ)
def read_ts(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in streams:
        rows = [_demux(x) for x in batch]
        yield pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in FIELDS})


def feature(m: Column) -> Column:
    """Program, packets, timestamps and random-access points in one line."""
    return F.format_string(
        "pmt=%d es=%d type=%d packets=%d cc_errors=%d pcr=%d pes=%d pts=%d..%d rap=%s",
        m["pmt_pid"], m["es_pid"], m["stream_type"], m["packets"], m["continuity_errors"], m["clock_references"], F.size(m["pts"]), F.element_at(m["pts"], 1), F.element_at(m["pts"], -1),
        F.concat_ws(",", F.transform(m["random_access"], lambda r: F.concat(r["pts"].cast("string"), F.lit("@"), r["byte"].cast("string")))),
    )


def media_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, media (the stored stream) and stream (what was read back from it).

    Python hands on ``ROWS`` streams at a time, so its memory doesn't follow the size of Spark's batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(READ)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                streams = [mux(padded(x)) for x in part.column(1).to_pylist()]
                read = pa.array([_demux(x) for x in streams], kind)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(streams, pa.binary()), read], ["doc_id", "text", "media", "stream"])

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = T.StructType([own.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("media", T.BinaryType()), T.StructField("stream", READ)])
    return own.mapInArrow(run, fields)

"""Streams that others may write: repeated packets, a network entry, jumps of counters, and broken ones."""

import struct

import pytest

from cardloom.llm import media


def packets(stream):
    return [stream[i : i + media.PACKET] for i in range(0, len(stream), media.PACKET)]


DATA = bytes(range(256)) * 300


def test_repeated_packets_count_once():
    whole = packets(media.write_stream(DATA))
    twice = b"".join(p * (2 if i % 7 == 3 or i < 3 else 1) for i, p in enumerate(whole))
    got = media.read_stream(twice)
    assert (got["payload"], got["gaps"]) == (DATA, 0)
    assert got["units"] == media.read_stream(b"".join(whole))["units"]


def test_network_entry_first():
    own = media._section(0x00, 1, struct.pack(">HHHH", 0, 0xE010, media.PROGRAM, 0xE000 | media.PMT_PID))
    count, out = 0, []
    for p in packets(media.write_stream(DATA)):
        if struct.unpack_from(">H", p, 1)[0] & 0x1FFF == media.PAT_PID:
            p, count = media._table_packet(media.PAT_PID, own, count), count + 1
        out.append(p)
    got = media.read_stream(b"".join(out))
    assert (got["payload"], got["program"], got["table_pid"], got["gaps"]) == (DATA, media.PROGRAM, media.PMT_PID, 0)
    alone = media._section(0x00, 1, struct.pack(">HH", 0, 0xE010))
    with pytest.raises(ValueError):
        media.read_stream(media._table_packet(media.PAT_PID, alone, 0))


def test_lost_packets_are_gaps_but_announced_jumps_are_not():
    whole = packets(media.write_stream(DATA))
    shifted = [p if i < 5 or struct.unpack_from(">H", p, 1)[0] & 0x1FFF != media.ES_PID else p[:3] + bytes([p[3] & 0xF0 | (p[3] + 5) & 15]) + p[4:] for i, p in enumerate(whole)]
    assert media.read_stream(b"".join(shifted))["gaps"] == 1
    first = next(i for i in range(5, len(shifted)) if shifted[i][3] & 0x20 and shifted[i][4])
    jump = lambda p: p[:5] + bytes([p[5] | 0x80]) + p[6:]
    late = [p if i < first or struct.unpack_from(">H", p, 1)[0] & 0x1FFF != media.ES_PID else p[:3] + bytes([p[3] & 0xF0 | (p[3] + 5) & 15]) + p[4:] for i, p in enumerate(whole)]
    late[first] = jump(late[first])
    got = media.read_stream(b"".join(late))
    assert (got["payload"], got["gaps"]) == (DATA, 0)

import hashlib
import struct
import zlib

import numpy as np
import pytest
from helpers import by_id, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.binary(min_size=1, max_size=40))
def test_stored_payloads_are_read_back_by_the_tables(units, seed):
    payload = (seed * (units * M.UNIT))[: units * M.UNIT]
    data = M.store(payload)
    track = M.probe(data)
    assert M.read_back(data, track) == payload
    assert track.codec == "raw " and track.duration == len(payload) and len(track.sizes) == units
    assert len(track.key_ranges()) == -(-units // M.KEY_EVERY)
    for n, (a, b) in enumerate(track.key_ranges()):
        assert data[a:b] == payload[n * M.KEY_EVERY * M.UNIT :][: M.UNIT]


def test_boxes_nest_and_end_where_they_say():
    data = M.store(b"x" * M.UNIT)
    paths = [b"/".join(p).decode() for p, _, _ in M.walk(data)]
    assert paths[0] == "ftyp" and paths[-1] == "mdat" and "moov/trak/mdia/minf/stbl/stsz" in paths


def test_64_bit_boxes_open_ended_boxes_and_tables_of_sizes():
    payload = b"abcdefghij"
    sizes = [1, 2, 3, 4]

    def table(at):
        return M.box(
            b"stbl", M.full(b"stsd", 0, struct.pack(">I", 1), M.box(b"avc1", bytes(78))), M.full(b"stsz", 0, struct.pack(">II4I", 0, 4, *sizes)),
            M.full(b"stsc", 0, struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)), M.full(b"co64", 0, struct.pack(">I2Q", 2, at, at + 6)), M.full(b"stss", 0, struct.pack(">I2I", 2, 1, 4)),
        )

    def movie(at):
        head = M.full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 1000, 2500, 0, 0))
        return M.box(b"moov", M.box(b"trak", M.box(b"mdia", head, M.box(b"minf", table(at)))))

    lead = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    at = len(lead) + len(movie(0)) + 8
    data = lead + movie(at) + struct.pack(">I4s", 0, b"mdat") + payload
    track = M.probe(data)
    assert M.read_back(data, track) == payload
    assert (track.codec, track.timescale, track.duration) == ("avc1", 1000, 2500)
    assert [data[a:b] for a, b in track.key_ranges()] == [b"a", b"ghij"]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 700), st.integers(0, 255), st.integers(0, 1200))
def test_damage_is_an_error_or_harmless(at, value, cut):
    data = bytearray(M.store(bytes(range(256)) * 9))
    data[at] = value
    try:
        M.read_back(bytes(data), M.probe(bytes(data)))
        M.probe(bytes(data[:cut]))
    except M.Malformed:
        pass


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 288), (4, "x" * 575), (5, "x" * 577), (6, prose(40000, 1)), (None, "a"), (7, "same"), (8, "same"), (8, "same")]
    found = M.store_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows) and M.store_documents(documents(spark, [])).count() == 0
    for r in found:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (M.UNIT if not raw else -len(raw) % M.UNIT)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
        assert r["media_sha256"] == hashlib.sha256(M.store(want)).hexdigest() and r["media_bytes"] == len(M.store(want))
    assert len({tuple(r)[1:] for r in found if r["doc_id"] in (7, 8)}) == 1


def test_columns_of_a_table_of_containers(spark):
    rows = [(1, bytearray(M.store(b"y" * 20 * M.UNIT)), "kept"), (2, bytearray(b"junk"), "kept"), (3, None, None)]
    found = {r["id"]: r for r in M.describe(spark.createDataFrame(rows, "id long, media binary, media_codec string")).collect()}
    assert found[1]["media_codec"] == "raw " and len(found[1]["media_keyframes"]) == 3 and found[1]["media_error"] is None
    assert [x["codec"] for x in found[1]["media_tracks"]] == ["raw "] and found[2]["media_tracks"] is None
    assert found[2]["media_codec"] is None and found[2]["media_error"] and found[3]["media_error"] == "null"


def test_only_whole_units_are_stored():
    for bad in (b"", b"x" * 575):
        with pytest.raises(ValueError):
            M.store(bad)
    assert np.dtype(">u4").itemsize == 4


def trak(number, codec, sizes, at, keys=None, narrow=False):
    table = M.full(b"stz2", 0, struct.pack(">xxxBI", 4, len(sizes)), bytes((a << 4) | b for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False)))
    if not narrow:
        table = M.full(b"stsz", 0, struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes))
    parts = [M.full(b"stsd", 0, struct.pack(">I", 1), M.box(codec, bytes(78))), table, M.full(b"stsc", 0, struct.pack(">I3I", 1, 1, len(sizes), 1) if sizes else bytes(4)), M.full(b"stco", 0, struct.pack(">II", 1, at) if sizes else bytes(4))]
    if keys is not None:
        parts.append(M.full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    head = M.full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, number, 0, 0))
    return M.box(b"trak", head, M.box(b"mdia", M.full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 1000, 500 * number, 0, 0)), M.box(b"minf", M.box(b"stbl", *parts))))


def test_each_track_has_its_own_tables():
    payload = b"aabbbccccdde"

    def movie(at):
        return M.box(b"moov", trak(1, b"mp4a", [2, 3, 4], at), trak(2, b"avc1", [2, 1], at + 9, [2], narrow=True))

    data = movie(len(movie(0)) + 8) + M.box(b"mdat", payload)
    first, second = M.tracks(data)
    assert (first.codec, first.duration, len(first.keys)) == ("mp4a", 500, 3)  # no stss of its own: all are keyframes
    assert (second.codec, second.number, second.sizes.tolist()) == ("avc1", 2, [2, 1])
    assert [data[a:b] for a, b in second.key_ranges()] == [b"e"] and M.read_back(data, second) == b"dde"
    assert M.read_back(data, M.probe(data)) == b"aabbbcccc"


def test_fragments_add_samples_to_their_tracks():
    trex = M.full(b"trex", 0, struct.pack(">5I", 1, 1, 10, 3, M.NO_KEY))
    moov = M.box(b"moov", trak(1, b"avc1", [], 0), M.box(b"mvex", trex))

    def moof(offset):
        runs = M.full(b"trun", M.OFFSET_IN_RUN | M.FIRST_FLAGS_IN_RUN, struct.pack(">IiI", 2, offset, 0)), M.full(b"trun", 0x200 | 0x400, struct.pack(">I4I", 2, 1, M.NO_KEY, 2, 0))
        return M.box(b"moof", M.full(b"mfhd", 0, struct.pack(">I", 1)), M.box(b"traf", M.full(b"tfhd", 0x20000, struct.pack(">I", 1)), *runs))

    data = moov + moof(len(moof(0)) + 8) + M.box(b"mdat", b"abcdefghi")
    track = M.probe(data)
    assert M.read_back(data, track) == b"abcdefghi" and track.sizes.tolist() == [3, 3, 1, 2] and track.duration == 500 + 40
    assert [data[a:b] for a, b in track.key_ranges()] == [b"abc", b"hi"]
    with pytest.raises(M.Malformed):
        M.tracks(data[:-1])


def test_offsets_beyond_the_file_are_malformed():
    payload = b"x" * 8 * M.UNIT
    data = M.store(payload)
    at = data.index(b"stco") + 12
    # The same table with 64-bit offsets, one of them just below 2**64.
    for offset in (2**64 - 5, 2**63, 2**40):
        wide = data.replace(data[at - 16 : at + 4], M.full(b"co64", 0, struct.pack(">IQ", 1, offset)))
        grown = len(wide) - len(data)
        for name in (b"stbl", b"minf", b"mdia", b"trak", b"moov"):
            k = wide.index(name) - 4
            wide = wide[:k] + struct.pack(">I", struct.unpack_from(">I", wide, k)[0] + grown) + wide[k + 4 :]
        with pytest.raises(M.Malformed):
            M.tracks(wide)


def test_a_fragments_base_beyond_the_file_and_empty_headers_are_malformed():
    trex = M.full(b"trex", 0, struct.pack(">5I", 1, 1, 10, 3, 0))
    moov = M.box(b"moov", trak(1, b"avc1", [], 0), M.box(b"mvex", trex))
    head = M.full(b"tfhd", M.BASE_GIVEN, struct.pack(">IQ", 1, 2**64 - 1))
    with pytest.raises(M.Malformed):
        M.tracks(moov + M.box(b"moof", M.box(b"traf", head, M.full(b"trun", 0x200, struct.pack(">II", 1, 4)))))
    for name in (b"mdhd", b"tkhd", b"stsd", b"stsc", b"stco", b"stsz"):
        whole = trak(1, b"avc1", [2, 2], 8)
        k = whole.index(name) - 4
        size = struct.unpack_from(">I", whole, k)[0]
        # The box is emptied and stands last in the file: nothing behind it may be read in its place.
        cut = M.box(b"moov", whole[:k] + struct.pack(">I", 8) + name + M.box(b"free", bytes(size - 16)) + whole[k + size :])
        with pytest.raises(M.Malformed):
            M.tracks(cut)
        last = M.box(b"trak", M.box(b"mdia", M.box(b"minf", M.box(b"stbl", *(M.full(n, 0, bytes(8)) for n in (b"stsd", b"stsc", b"stco")))), M.box(b"mdhd")))
        with pytest.raises(M.Malformed):
            M.tracks(M.box(b"moov", last))


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 2, 3, 7, 8, 0x7F, 0xFF, 0x7FFFFFFF, 0x80000000, 0xFFFFFFFB, 0xFFFFFFFF, 2**63, 2**64 - 1, 2**64 - 5]), st.sampled_from([">I", ">Q", ">H"]), st.integers(0, 5), st.integers(0, 5))
def test_whole_fields_and_the_order_of_boxes_may_be_anything(at, value, form, first, second):
    trex = M.full(b"trex", 0, struct.pack(">5I", 1, 1, 10, 3, 0))
    runs = M.full(b"trun", M.OFFSET_IN_RUN | 0x200, struct.pack(">Ii2I", 2, 8, 1, 2))
    moof = M.box(b"moof", M.box(b"traf", M.full(b"tfhd", M.BASE_GIVEN, struct.pack(">IQ", 1, 0)), runs))
    boxes = [M.store(b"y" * 3 * M.UNIT), M.box(b"moov", trak(1, b"avc1", [2, 1], 0, [1]), trak(2, b"mp4a", [1, 2, 3], 4, narrow=True), M.box(b"mvex", trex)), moof, M.box(b"mdat", b"0123456789"), M.box(b"free"), moof]
    boxes[first], boxes[second] = boxes[second], boxes[first]
    data = bytearray(b"".join(boxes))
    at %= len(data) - 8
    struct.pack_into(form, data, at, value % 2 ** (8 * struct.calcsize(form)))
    try:
        for t in M.tracks(bytes(data)):
            M.read_back(bytes(data), t)
            assert all(0 <= a <= b <= len(data) for a, b in t.key_ranges())
    except M.Malformed:
        pass

"""Makers' tags from bytes built here, and their focus points; a walk that ends on any bytes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from siftwell.functions import markers
from siftwell.sources import tags

CODE = {2: "s", 3: "H", 4: "I", 5: "I", 7: "s", 1: "B"}


def directory(order, at, entries, base=0, following=0):
    """Bytes of a directory that stands `at` in the file, its values behind it; offsets count from base."""
    head, tail = struct.pack(order + "H", len(entries)), b""
    behind = at + 2 + 12 * len(entries) + 4
    for number, kind, values in entries:
        data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{CODE[kind]}", *values)
        count = len(data) // tags.SIZES[kind]
        head += struct.pack(order + "HHI", number, kind, count) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", behind + len(tail) - base))
        tail += data if len(data) > 4 else b""
    return head + struct.pack(order + "I", following) + tail


def photo(make, model, maker, order="<", exif=(), orientation=1):
    """A TIFF file of three directories; maker: from the place of the maker's block to its bytes."""
    at = 8
    for _ in range(2):  # the second time all places are known
        ifd0 = directory(order, 8, [(0x010F, 2, make + b"\0"), (0x0110, 2, model + b"\0"), (0x0112, 3, [orientation]), (0x8769, 4, [at])])
        at = 8 + len(ifd0)
    for _ in range(2):
        place = at + len(directory(order, at, [*exif, (0x927C, 7, b"?" * 100)])) - 100
        block = maker(place)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + ifd0 + directory(order, at, [*exif, (0x927C, 7, block)])


def canon_block(order="<", focus=1, selected=(0b10, 0), sharp=(0b110, 0), widths=None, valid=3):
    n = 20
    widths = widths or [200, 200, 200, *[0] * 17]
    heights, xs, ys = [100 if w else 0 for w in widths], [0, -1000, 500, *[0] * 17], [0, 300, -200, *[0] * 17]
    words = [0, 2, n, valid, 6000, 4000, 6000, 4000, *widths, *heights, *(v & 0xFFFF for v in xs), *(v & 0xFFFF for v in ys), *sharp, *selected]
    return lambda place: directory(order, place, [(0x0001, 3, [0] * 7 + [focus]), (0x0026, 3, words)])


def sony_block(location=(6000, 4000, 3000, 1000), frame=(600, 400, 1), focus=2):
    return lambda place: b"SONY DSC \0\0\0" + directory("<", place + 12, [(0x201B, 1, [focus]), (0x2027, 3, list(location)), (0x2037, 7, struct.pack("<3H", *frame))])


def panasonic_block(place):
    return b"Panasonic\0\0\0" + directory("<", place + 12, [(0x0007, 3, [6]), (0x000F, 1, [16, 0]), (0x004D, 5, [1, 4, 1, 2]), (0x00DE, 5, [1, 10, 1, 5])])


def nikon_block(place):
    own = place + 10
    return b"Nikon\0\x02\x10\0\0" + b"MM" + struct.pack(">HI", 42, 8) + directory(">", own + 8, [(0x0001, 2, b"0402 long value\0")], own)


EXIF = [(0xA002, 4, [6000]), (0xA003, 4, [4000])]


def test_four_makers(spark):
    files = [
        photo(b"Canon", b"Canon EOS R3", canon_block(), exif=EXIF), photo(b"SONY", b"ILCE-6600", sony_block(), exif=EXIF), photo(b"Panasonic", b"DC-S5M2", panasonic_block), photo(b"NIKON CORPORATION", b"NIKON Z5_2", nikon_block),
        b"JUNK" + b"Exif\0\0" + photo(b"Canon", b"Canon EOS R3", canon_block(">"), ">", [(0xA002, 4, [6000]), (0xA003, 4, [4000])]), None, b"", b"II*\0",
    ]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content binary").withColumn("tags", tags.tags(F.col("content")))
    got = {r["i"]: r for r in df.withColumn("m", markers.focus_points(F.col("tags"))).collect()}
    assert got[0]["tags"]["IFD0:Model"] == "Canon EOS R3" and got[0]["tags"]["ExifIFD:ExifImageWidth"] == "6000" and got[0]["tags"]["Canon:AFAreaXPositions"].split()[1] == "-1000"
    for i in (0, 4):  # either order of bytes
        m = got[i]["m"]
        assert (m["vendor"], m["status"], m["reason"]) == ("canon", "not_validated", "active_camera_AF_geometry_only")
        assert [(p["index"], p["role"], round(p["x"], 6), round(p["y"], 6)) for p in m["points"]] == [(1, "selected_and_camera_reported_in_focus", round(2000 / 6000, 6), 0.425), (2, "camera_reported_in_focus", round(3500 / 6000, 6), 0.55)]
    sony = got[1]["m"]
    assert sony["reason"] == "playback_location_geometry_only" and tuple(sony["points"][0])[2:] == pytest.approx((0.5, 0.25, 0.1, 0.1))
    panasonic = got[2]["m"]
    assert panasonic["reason"] == "normalized_geometry_only" and tuple(panasonic["points"][0])[2:] == pytest.approx((0.25, 0.5, 0.1, 0.2))
    assert got[3]["tags"]["Nikon:0x0001"] == "0402 long value" and got[3]["m"]["reason"] == "af_info2_version_unsupported"
    assert all(got[i]["tags"] is None and got[i]["m"]["status"] == "unknown" for i in (5, 6)) and got[7]["tags"] is None


def test_loops_and_lies_end():
    loop = b"II*\0" + struct.pack("<I", 8) + directory("<", 8, [(0x8769, 4, [8]), (0x014A, 4, [8, 8, 50]), (0x010F, 2, b"ab\0"), (0x0110, 2, b"x" * 9)])
    assert tags.walk(loop)["IFD0:Make"] == "ab"
    lies = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 65535) + struct.pack("<HHII", 0x010F, 2, 1 << 31, 8) + struct.pack("<HHII", 0x0112, 3, 1, 6)
    assert tags.walk(lies) == {"IFD0:Orientation": "6"}
    deep = bytearray(b"II*\0" + struct.pack("<I", 8))
    for i in range(50):  # each one leads to the next
        deep += directory("<", len(deep), [(0x8769, 4, [len(deep) + 18]), ])
    assert tags.walk(bytes(deep)) == {}
    rng = random.Random(1)
    whole = photo(b"Canon", b"Canon EOS R3", canon_block(), exif=EXIF)
    for _ in range(3000):
        data = bytearray(whole[: rng.randrange(len(whole) + 1)])
        for _ in range(rng.randrange(6)):
            if len(data) > 8:
                data[rng.randrange(8, len(data))] = rng.randrange(256)
        tags.walk(bytes(data))
    many = b"II*\0" + struct.pack("<I", 8) + directory("<", 8, [(i, 3, [i]) for i in range(1000, 1000 + 3000)])
    assert len(tags.walk(many)) == tags.ENTRIES


def decoded(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t map<string,string>")
    return [r["m"] for r in df.withColumn("m", markers.focus_points(F.col("t"))).orderBy("i").collect()]


def test_canon_rejects_the_whole_record(spark):
    good = tags.walk(photo(b"Canon", b"Canon EOS R3", canon_block(), exif=EXIF))
    cases = [
        ({"Canon:NumAFPoints": None}, "point_counts_missing_invalid_or_conflicting"), ({"Canon:ValidAFPoints": "21"}, "point_counts_missing_invalid_or_conflicting"), ({"Canon:AFImageWidth": "0"}, "missing_invalid_or_conflicting_af_frame"), ({"Canon:AFAreaWidths": "1 2"}, "point_arrays_missing_invalid_or_conflicting"),
        ({"Canon:AFAreaXPositions": "9999 " + "0 " * 19}, "valid_point_geometry_outside_frame_or_nonpositive"), ({"Canon:AFAreaXPositions": "2950 " + "0 " * 19}, "valid_point_area_extends_outside_frame"), ({"Canon:ValidAFPoints": "4"}, "valid_point_count_does_not_match_positive_areas"),
        ({"Canon:AFPointsSelected": "8 0"}, "point_state_invalid_or_conflicting"), ({"Canon:AFPointsInFocus": "0 256"}, "point_state_invalid_or_conflicting"), ({"Canon:AFPointsInFocus": "0 0", "Canon:AFPointsSelected": None}, "no_reported_active_AF_point"),
        ({"Canon:FocusMode": "3"}, "focus_mode_not_supported"), ({"Canon:AFAreaMode": "0"}, "focus_mode_not_supported"), ({"ExifIFD:ExifImageWidth": "5999"}, "recorded_dimensions_mismatch"), ({"Track4:NumAFPoints": "20"}, "point_counts_missing_invalid_or_conflicting"), ({}, "active_camera_AF_geometry_only"),
    ]
    got = decoded(spark, [{k: v for k, v in (good | change).items() if v is not None} for change, _ in cases])
    assert [m["reason"] for m in got] == [w for _, w in cases] and all(bool(m["points"]) == (m["status"] == "not_validated") for m in got)


def test_sony_and_nikon_and_panasonic_reject(spark):
    sony = {"IFD0:Make": "SONY ", "IFD0:Model": "ILCE-6600", "Sony:FocusMode": "2", "Sony:FocusLocation": "6000 4000 100 100", "Sony:FocusFrameSize": "100 100 1"}
    nikon = {"IFD0:Make": "NIKON CORPORATION", "IFD0:Model": "NIKON Z5_2", "Nikon:AFInfo2Version": "0402", "Nikon:AFDetectionMethod": "2", "Nikon:AFCoordinatesAvailable": "1", "Nikon:FocusMode": "AF-S  ", "Nikon:AFAreaMode": "193", "Nikon:AFImageWidth": "6048", "Nikon:AFImageHeight": "4032", "Nikon:AFAreaXPosition": "3024", "Nikon:AFAreaYPosition": "100", "Nikon:AFAreaWidth": "200", "Nikon:AFAreaHeight": "100"}
    lumix = {"IFD0:Make": "Panasonic", "Panasonic:FocusMode": "6", "Panasonic:AFAreaMode": "128 0", "Panasonic:AFPointPosition": "0.5 0.5", "Panasonic:AFAreaSize": "0.2 0.2"}
    cases = [
        (sony, {}, "playback_location_geometry_only"), (sony, {"Sony:FocusLocation": "6000 4000 3000 2000"}, "camera_center_fallback_ambiguous"), (sony, {"Sony:FocusLocation": "6000 4000 6000 1"}, "focus_location_outside_frame"), (sony, {"Sony:FocusLocation": None}, "missing"), (sony, {"X:Sony:FocusLocation": "1 1 1 1"}, "ambiguous_instances"),
        (sony, {"Sony:FocusLocation": "6000 4000 1.5 2"}, "invalid_focus_location"), (sony, {"Sony:FocusFrameSize": "100 100 0"}, "invalid_or_ambiguous_focus_frame"), (sony, {"Sony:FocusFrameSize": "900 900 1"}, "area_extends_outside_frame"), (sony, {"Sony:FocusFrameSize": None}, "playback_location_geometry_only"), (sony, {"Sony:FocusMode": "0"}, "focus_mode_not_supported"), (sony, {"IFD0:Model": "ILCE-7"}, "unsupported_or_unknown_camera"),
        (nikon, {}, "camera_AF_geometry_only"), (nikon, {"Nikon:AFInfo2Version": "0400"}, "af_info2_version_unsupported"), (nikon, {"Nikon:FocusMode": "MF"}, "focus_mode_not_supported"), (nikon, {"Nikon:AFCoordinatesAvailable": "0"}, "af_coordinates_unavailable_or_unsupported"), (nikon, {"Nikon:AFImageHeight": None}, "missing_invalid_or_ambiguous_af_frame"),
        (nikon, {"Nikon:AFAreaXPosition": "x"}, "af_center_missing_invalid_or_ambiguous"), (nikon, {"Nikon:AFAreaMode": "197", "Nikon:AFAreaXPosition": "0", "Nikon:AFAreaYPosition": "0"}, "auto_or_tracking_has_no_determined_target"), (nikon, {"Nikon:AFAreaXPosition": "6048"}, "af_center_outside_reference_frame"), (nikon, {"Nikon:AFAreaWidth": None}, "af_area_size_partial_invalid_or_ambiguous"), (nikon, {"Nikon:AFAreaHeight": "300"}, "af_area_extends_outside_reference_frame"), (nikon, {"Nikon:AFAreaWidth": None, "Nikon:AFAreaHeight": None}, "camera_AF_geometry_only"),
        (lumix, {}, "normalized_geometry_only"), (lumix, {"Panasonic:AFPointPosition": "1.5 0"}, "invalid_or_ambiguous_point"), (lumix, {"Panasonic:AFPointPosition": "NaN 0"}, "invalid_or_ambiguous_point"), (lumix, {"Panasonic:AFAreaSize": "0 1"}, "invalid_or_ambiguous_area"), (lumix, {"Panasonic:AFAreaSize": None}, "normalized_geometry_only"), (lumix, {"Panasonic:AFPointPosition": "0.05 0.5"}, "area_extends_outside_frame"), (lumix, {"Panasonic:AFAreaMode": "240 0"}, "focus_mode_not_supported"), (lumix, {"IFD0:Make": "Other"}, "unsupported_or_unknown_camera"),
    ]
    got = decoded(spark, [{k: v for k, v in (base | change).items() if v is not None} for base, change, _ in cases])
    assert [m["reason"] for m in got] == [w for _, _, w in cases]
    unsized = got[21]["points"][0]
    assert unsized["role"] == "camera_reported_AF_point" and unsized["w"] is None


def test_points_turn_with_the_photo(spark):
    df = spark.createDataFrame([(o, [(0, "r", 0.25, 0.5, 0.1, 0.2), (1, "r", 0.25, 0.5, None, None)]) for o in (1, 3, 6, 9, None)], f"o int, p {markers.NO_POINTS}")
    got = {r["o"]: r["u"] for r in df.select("o", markers.upright(F.col("p"), F.col("o")).alias("u")).collect()}
    assert got[9] is None and got[None] is None and tuple(got[1][0])[2:] == pytest.approx((0.25, 0.5, 0.1, 0.2)) and tuple(got[3][0])[2:] == pytest.approx((0.75, 0.5, 0.1, 0.2))
    assert tuple(got[6][0])[2:] == pytest.approx((0.5, 0.25, 0.2, 0.1)) and got[6][1]["w"] is None


def test_a_tag_is_looked_up_once(spark):
    df = spark.createDataFrame([({"IFD0:Make": "SONY "},)], "t map<string,string>").select(markers.sony(F.col("t")).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_keys(") == 5 and plan.count("playback_location_geometry_only") == 1  # make, model, mode, location, frame

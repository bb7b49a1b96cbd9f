"""Archives: exact round trip, salvage of damaged files, gaps without holes."""

import base64
import glob
import gzip
import hashlib
import random

import pytest

from wardwatch.llm import warc

PAGES = "page_id long, url string, html string, digest string, first long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)


def given():
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("ab<é\r\n ") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, None, "same payload") for i in range(30)]
    return rows + [(None, None, None), (200, "u\r\nX: y", ""), (201, "", "x" * 3_000_000), (300, "again", "same payload"), (300, "again", "same payload")]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    rows = given()
    manifest = warc.write_archives(pages_of(spark, rows), str(tmp_path / "w"), segment=10_000, compress=compress)
    found = warc.read_archives(manifest).collect()
    assert {r["kind"] for r in found} == {"record"} and len(found) == len(rows) == sum(r["records"] for r in manifest.collect())
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    by_id = {}
    for r in found:
        by_id.setdefault(r["record_id"], []).append(r)
    for i, url, html in rows:
        payload = html or ""
        for r in by_id[warc.ID.format("" if i is None else i)]:
            revisit = i is None or best[payload] != i
            assert (r["record_type"], r["payload_bytes"], r["payload_digest"]) == ("revisit" if revisit else "response", len(payload.encode()), digest(payload))
            assert r["refers_to"] == (warc.ID.format(best[payload]) if revisit else None)
            assert revisit or r["payload"].decode() == payload


def test_short_payloads_are_never_revisits_and_empty_tables_work(spark, tmp_path):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    manifest = warc.write_archives(pages_of(spark, rows), str(tmp_path / "a"), least=5)
    assert sorted(r["record_type"] for r in warc.read_archives(manifest).collect()) == ["response"] * 3 + ["revisit"]
    assert warc.read_archives(warc.write_archives(pages_of(spark, []), str(tmp_path / "b"))).count() == 0


def members(count, compress):
    rng = random.Random(count)
    out = []
    for i in range(count):
        payload = "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 3000))).encode()
        data = warc.record_bytes(i, f"http://h/{i}", payload, digest(payload.decode()), None, True)
        out.append(gzip.compress(data) if compress else data)
    return out


def read(spark, path):
    rows = warc.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    return [r["record_id"] for r in rows if r["kind"] == "record"], [(r["offset"], r["length"], r["reason"]) for r in rows if r["kind"] == "gap"]


def ids(numbers):
    return [warc.ID.format(i) for i in numbers]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_the_damaged_records(spark, tmp_path, compress):
    parts = members(12, compress)
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    data = bytearray(b"".join(parts))
    data[starts[3] + len(parts[3]) // 2] ^= 0x55  # flipped inside
    data[starts[6]] ^= 0xFF  # no longer a member or a version line
    whole = bytes(data[: starts[9]]) + b"junk WARC/1.1 junk \x1f\x8b\x08 junk" * 5 + bytes(data[starts[9] : starts[11] + 20])
    path = tmp_path / "damaged"
    path.write_bytes(whole)
    found, gaps = read(spark, path)
    assert found == ids([0, 1, 2, 4, 5, 7, 8, 9, 10])
    junk = starts[9]
    assert [(o, n) for o, n, _ in gaps] == [
        (starts[3], len(parts[3])), (starts[6], len(parts[6])), (junk, 5 * len(b"junk WARC/1.1 junk \x1f\x8b\x08 junk")), (len(whole) - 20, 20)
    ]
    assert all(reason for *_, reason in gaps)


def test_a_wrong_length_is_found_and_the_next_record_recovered(spark, tmp_path):
    parts = members(4, False)
    wrong = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    path = tmp_path / "lengths"
    path.write_bytes(parts[0] + wrong + parts[2] + gzip.compress(parts[3]))
    found, gaps = read(spark, path)
    assert found == ids([0, 2, 3]) and [(o, n) for o, n, _ in gaps] == [(len(parts[0]), len(wrong))]


def test_a_record_inside_a_payload_is_not_taken_for_a_record(spark, tmp_path):
    inner = members(2, False)[0]
    outer = warc.record_bytes(77, None, inner, digest(inner.decode()), None, True)
    path = tmp_path / "nested"
    path.write_bytes(outer + gzip.compress(outer, 0))
    assert read(spark, path) == (ids([77, 77]), [])


def test_several_records_in_a_member_and_files_without_any(spark, tmp_path):
    path = tmp_path / "one"
    path.write_bytes(gzip.compress(b"".join(members(5, False))))
    assert read(spark, path) == (ids(range(5)), [])
    (tmp_path / "empty").write_bytes(b"")
    assert read(spark, tmp_path / "empty") == ([], [])
    (tmp_path / "noise").write_bytes(b"\x1f\x8b\x08" * 1000)
    found, gaps = read(spark, tmp_path / "noise")
    assert found == [] and [(o, n) for o, n, _ in gaps] == [(0, 3000)]


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    manifest = warc.write_archives(pages_of(spark, [(1, "u", "x")]), str(tmp_path / "w"))
    [path] = glob.glob(str(tmp_path / "w" / "*.warc.gz"))
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(open(path, "rb").read())
    assert warc.read_archives(manifest).count() == 1


@pytest.mark.parametrize("compress", [True, False])
def test_urls_of_any_length(spark, tmp_path, compress):
    rows = [(1, "http://h/" + "x" * 100_000, "page"), (2, "http://h/" + "é" * 3_000_000, "page"), (3, "u", "other")]
    rows += [(9 + n, "x" * (warc.HEADER - 330 + n), "") for n in range(30)]  # the blank line across the end of a step
    found = warc.read_archives(warc.write_archives(pages_of(spark, rows), str(tmp_path / "w"), compress=compress)).collect()
    assert {(r["kind"], r["record_id"], r["target"]) for r in found} == {("record", warc.ID.format(i), url) for i, url, _ in rows}


def test_a_header_without_end_is_a_gap(spark, tmp_path):
    endless = b"WARC/1.1\r\nWARC-Type: response\r\n" + b"no colon\r\n" * 20_000
    path = tmp_path / "endless"
    path.write_bytes(endless + members(1, False)[0] + b"WARC/1.1\r\nX: " + b"y" * 200_000)
    found, gaps = read(spark, path)
    assert found == ids([0]) and [n for _, n, _ in gaps] == [len(endless), 200_013]
    assert [reason for *_, reason in gaps] == ["header line", "header end"]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("plain_next", [True, False])
def test_damage_in_a_member_of_several_records(spark, tmp_path, level, plain_next):
    parts = members(8, False)
    after = members(9, not plain_next)[8]
    starts = [sum(map(len, parts[:i])) for i in range(9)]

    def damaged(*places):
        data = bytearray(b"".join(parts))
        for place in places:
            data[place] ^= 0x55
        return bytes(data)

    path = tmp_path / "inside"  # the member itself is intact; its first record has no version line
    member = gzip.compress(damaged(starts[0], starts[3] + len(parts[3]) // 2, starts[7] + 200), level)
    path.write_bytes(member + after)
    found, gaps = read(spark, path)
    assert found == ids([1, 2, 4, 5, 6, 8])
    assert [(o, n) for o, n, _ in gaps] == [(0, len(member))] * 3
    assert f"bytes {starts[3]} to {starts[4]} of the member" in gaps[1][2]

    path = tmp_path / "checksum"
    member = bytearray(gzip.compress(b"".join(parts), level))
    member[-6] ^= 0x55
    path.write_bytes(bytes(member) + after)
    found, gaps = read(spark, path)
    assert found == ids(range(9)) and [(o, n) for o, n, _ in gaps] == [(0, len(member))]

    path = tmp_path / "cut"
    member = gzip.compress(b"".join(parts), level)
    path.write_bytes(member[: len(member) * 2 // 3] + after)
    found, gaps = read(spark, path)
    assert len(found) == len(set(found)) and found[:3] == ids(range(3)) and ids([7])[0] not in found and found[-1] == ids([8])[0]
    assert gaps[0][0] == 0 and gaps[0][1] >= len(member) * 2 // 3  # a stored block goes on into the next record

    path = tmp_path / "data"
    member = bytearray(member)
    member[len(member) // 2] ^= 0x55
    path.write_bytes(bytes(member) + after)
    found, gaps = read(spark, path)
    assert len(found) == len(set(found)) and found[:2] == ids(range(2)) and ids([8])[0] in found and gaps


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.total = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, count):
        out = self.data[self.at : self.at + count]
        self.at, self.total = self.at + len(out), self.total + len(out)
        return out


def peak_of(work):
    import tracemalloc

    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def many_records(count, size):
    payload = b"x" * size
    return [warc.record_bytes(i, None, payload + str(i).encode(), digest((payload + str(i).encode()).decode()), None, True) for i in range(count)]


def kinds(data):
    file = Counted(data)
    found = [(k, r.headers["warc-record-id"] if r else why) for k, _, _, why, r in warc.salvage(warc.Window(file, len(data)))]
    return found, file.total


def test_damaged_lengths_do_not_read_the_rest_of_the_file():
    records = many_records(60, 100_000)
    spoiled = [r.replace(b"Content-Length: 1000", b"Content-Length: 3999", 2) if i % 2 else r for i, r in enumerate(records)]
    data = b"".join(spoiled)
    (found, read), peak = peak_of(lambda: kinds(data))
    assert [i for k, i in found if k == "record"] == ids(range(0, 60, 2)) and sum(k == "gap" for k, _ in found) == 30
    assert read < 4 * len(data) + 60 * warc.PIECE and peak < 8 * warc.PIECE


@pytest.mark.parametrize("damage", [None, "cut", "inside", "bytes"])
def test_large_members_pass_through_a_window(damage):
    """60 MB in one member of some kilobytes: all records come out in a few megabytes, whatever is damaged."""
    records = many_records(60, 1_000_000)
    whole, lost = b"".join(records), []
    if damage == "inside":
        whole = b"".join(r.replace(b"WARC/1.1", b"WARC/x.1") if i in (3, 40) else r for i, r in enumerate(records))
        lost = [3, 40]
    packed = gzip.compress(whole, 1)
    if damage == "cut":
        packed = packed[: len(packed) // 2]
    if damage == "bytes":
        at = len(packed) // 2
        packed = packed[:at] + bytes(b ^ 255 for b in packed[at : at + 40]) + packed[at + 40 :]
    tail = gzip.compress(many_records(1, 10)[0].replace(b"page:0>", b"page:99>"))
    del whole, records
    (found, _), peak = peak_of(lambda: kinds(packed + tail))
    known = [i for k, i in found if k == "record"]
    if damage in (None, "inside"):
        assert known == ids([*[i for i in range(60) if i not in lost], 99]) and sum(k == "gap" for k, _ in found) == len(lost)
    else:
        kept = len(known) - 1
        assert known == ids([*range(kept), 99]) and 20 <= kept < 60 and found[0][0] == "gap"
    assert peak < 16 * warc.PIECE


def test_small_and_large_members_are_read_alike(monkeypatch):
    rng = random.Random(8)
    records = many_records(12, 3_000)
    joined = [b"".join(rng.sample(records, 6)) for _ in range(3)]
    joined[1] = joined[1].replace(b"sha1:", b"sha1:A", 3)
    data = b"".join(gzip.compress(j) for j in joined)
    data = data[:100] + b"junk" + data[100:]
    want = kinds(data)[0]
    monkeypatch.setattr(warc, "SMALL", 1)
    monkeypatch.setattr(warc, "PIECE", 700)
    assert kinds(data)[0] == want and any(k == "record" for k, _ in want)

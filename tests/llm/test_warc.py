import random
import subprocess
import sys
import zlib

import pytest

from tabularlab.llm import warc
from tabularlab.llm.common import Scratch

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "u 4\r\nx: y", None),
         (5, "http://a/5", ""), (6, "http://a/6", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nzß" * 3), (2, "http://a/2", "<p>two</p>"),
         (None, "http://a/n", "<p>one</p>"), (None, None, "<p>only null</p>"), (9, "http://a/9", "x" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, record_type int")


def expected(rows):
    first = {}
    for i, _, html in rows:
        key = html or ""
        first[key] = min((x for x in (first.get(key), i) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        data, f = (html or "").encode(), first[html or ""]
        out.append((i, len(data), warc.digest(data), "response" if f is None or i == f else "revisit", None if f is None or i == f else f))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.archive_report(pages(spark)).collect()), key=repr)
    assert got == expected(PAGES)
    assert warc.archive_report(pages(spark).limit(0)).count() == 0


def test_archives_are_gzip_members_and_payloads_come_back(spark):
    with Scratch(spark, "test") as scratch:
        out = scratch.path("archives")
        scratch.paths.append(out)
        warc.write_archives(pages(spark), out, archive_bytes=500)
        files = spark.read.format("binaryFile").load(out).collect()
        assert len(files) > 1
        for f in files:
            data, at = bytes(f.content), 0
            while at < len(data):
                content, at = warc.read_member(data, at)
                assert content == b"" or content.startswith(b"WARC/1.1\r\n")
        rows = warc.read_archives(spark, out).where("record_type = 'response'").collect()
        assert sorted(bytes(r.payload) for r in rows) == sorted((p[2] or "").encode() for p in PAGES
                                                                if p[0] is None and "null" in p[2] or p[0] in (1, 2, 4, 6, 9))
        assert warc.read_archives(spark, out).where("kind = 'gap'").count() == 0


def parts():
    return [warc.page_record(i, f"http://a/{i}", (f"<p>{i}</p>" * 40).encode(), None) for i in range(8)]


def ids(found):
    return [x["record_id"] for k, _, _, x in found if k == "record"]


def test_salvage_skips_what_is_damaged_and_logs_the_gap():
    members = parts()
    broken = bytearray(members[3])
    broken[len(broken) // 2] ^= 0xFF
    members[3] = bytes(broken)
    data = b"".join(members)
    found = list(warc.salvage(data))
    assert ids(found) == [f"urn:page:{i}" for i in range(8) if i != 3]
    gap, = [(a, z) for k, a, z, _ in found if k == "gap"]
    start = sum(map(len, members[:3]))
    assert gap == (start, start + len(members[3]))


@pytest.mark.parametrize("window", [None, 64])       # 64: every record is read through many windows
@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_covers_every_byte_of_randomly_damaged_files(compressed, window, monkeypatch):
    if window:
        monkeypatch.setattr(warc, "WINDOW", window)
        monkeypatch.setattr(warc, "PIECE", 24)
    rng = random.Random(compressed)
    plain = [zlib.decompress(m, 31) for m in parts()]
    members = parts() if compressed else plain
    payloads = {(f"<p>{i}</p>" * 40).encode() for i in range(8)}
    bounds = [0]
    for m in members:
        bounds.append(bounds[-1] + len(m))
    for _ in range(60):
        data = bytearray(b"".join(members))
        at, size = rng.randrange(len(data)), rng.randint(1, 40)
        how = rng.choice(["flip", "cut", "insert"])
        if how == "flip":
            data[at: at + size] = bytes(b ^ 0x55 for b in data[at: at + size])
            hit = {i for i in range(8) if bounds[i] < at + size and at < bounds[i + 1]}
        elif how == "cut":
            del data[at: at + size]
            hit = {i for i in range(8) if bounds[i] < at + size and at < bounds[i + 1]}
        else:
            data[at:at] = rng.randbytes(size)
            hit = {i for i in range(8) if bounds[i] < at < bounds[i + 1]}
        found = list(warc.salvage(bytes(data)))
        assert {f"urn:page:{i}" for i in set(range(8)) - hit} <= set(ids(found))     # every sound record is recovered
        # and no damaged payload is passed off as sound (headers without a checksum may still differ)
        assert all(x["payload"] in payloads for k, _, _, x in found if k == "record")
        if compressed:     # a member's CRC covers its headers, too: each payload belongs to its record id
            for k, _, _, x in found:
                if k == "record":
                    assert x["payload"] == (f"<p>{x['record_id'].rsplit(':', 1)[1]}</p>" * 40).encode()
        spans = [(a, z) for _, a, z, _ in found]
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def test_truncated_empty_and_foreign_files():
    data = b"".join(parts())
    found = list(warc.salvage(data[:-10]))
    assert len(ids(found)) == 7 and found[-1][0] == "gap" and found[-1][2] == len(data) - 10
    assert list(warc.salvage(b"")) == []
    assert [x[:3] for x in warc.salvage(b"no archive at all")] == [("gap", 0, 17)]


def test_one_member_with_many_records():
    whole = warc.member(b"".join(zlib.decompress(m, 31) for m in parts()[:3]) + b"junk")
    found = list(warc.salvage(whole))
    assert len(ids(found)) == 3 and found[-1][0] == "gap" and "content" in found[-1][3]


READ = """
import resource, sys
from tabularlab.llm import warc
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with warc.open_archive("file:" + sys.argv[1]) as file:
    batches = list((b.num_rows, b.nbytes) for b in warc.batches_of("a", warc.Source(file, int(sys.argv[2])), True))
print(sum(n for n, _ in batches), max(m for _, m in batches), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


@pytest.mark.parametrize("compressed", [True, False])
def test_memory_does_not_follow_the_archive(tmp_path, compressed):
    html = random.Random(1).randbytes(200_000)
    one = warc.page_record(1, "http://a/1", html, None)
    one = one if compressed else zlib.decompress(one, 31)
    damaged = one[:len(one) // 2] + b"\0" + one[len(one) // 2:]
    n = 300 * (1 << 20) // len(one)
    path = tmp_path / "one archive.warc"              # a blank in the name
    with open(path, "wb") as f:
        for i in range(n):
            f.write(damaged if i == n // 2 else one)
        size = f.tell()
    said = subprocess.run([sys.executable, "-c", READ, str(path), str(size)], capture_output=True, text=True, check=True).stdout.split()
    rows, largest, grown_kb = map(int, said)
    assert rows == n and largest < 2 * warc.BATCH_BYTES          # n - 1 records and the gap
    assert grown_kb < 200_000                                     # 300 MB were read


def test_archives_of_many_runs(spark, monkeypatch):
    """Runs of a task follow each other in one file; an archive begins with its info record."""
    monkeypatch.setattr(warc, "RUN_BYTES", 2000)
    rows = [(i, f"http://a/{i}", f"<p>{random.Random(i).randbytes(300).hex()}</p>") for i in range(60)]
    with Scratch(spark, "test") as scratch:
        out = scratch.path("archives")
        scratch.paths.append(out)
        warc.write_archives(pages(spark, rows).coalesce(1), out, archive_bytes=8000)
        found = warc.read_archives(spark, out).collect()
        whole = warc.read_archives(spark, out, opener=lambda path: open(path.removeprefix("file:"), "rb")).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, found))
    assert sorted(r.record_id for r in found if r.record_type == "response") == sorted(f"urn:page:{i}" for i in range(60))
    files = {r.path for r in found}
    assert not [r for r in found if r.kind == "gap"] and len({r.path for r in found}) > 1
    assert sorted(r.path for r in found if r.record_type == "warcinfo") == sorted(files)
    assert all(r.start == 0 for r in found if r.record_type == "warcinfo")
    assert max(sum(r.path == f for r in found) for f in files) > 10          # several runs in one file

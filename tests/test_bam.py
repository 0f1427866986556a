import random
import struct
import zlib

import pytest

from strandweave.sources.bam import BamDataSource


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, cigar, seq, tags):
    code = "=ACMGRSVTWYHKDBN"
    packed = bytes(code.index(seq[i]) << 4 | (code.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar) + packed + bytes([30] * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


@pytest.mark.parametrize("split", [300, 5000, 1 << 27])
@pytest.mark.parametrize("block_bytes", [700, 20000])
def test_each_record_once_whatever_the_ranges(spark, tmp_path, split, block_bytes):
    rnd = random.Random(split + block_bytes)
    header = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 10**6) for n in (b"c1", b"c2"))
    data, want = header, set()
    for i in range(400):
        seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(1, 90)))
        tags = b"XAB" + b"S" + struct.pack("<i", 2) + b"\1\0\2\0" + b"NMC" + bytes([i % 5]) + b"MDZ" + b"=" * len(seq) + b"\0"
        data += record(f"r{i}", 16 * (i % 2), i % 3 - 1, i * 7 - 1, [(len(seq), "M")], seq, tags)
        want.add((f"r{i}", 16 * (i % 2), ("*", "c1", "c2")[i % 3], i * 7, f"{len(seq)}M", seq, i % 5, "=" * len(seq)))
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(block(data[i : i + block_bytes]) for i in range(0, len(data), block_bytes)) + block(b""))
    spark.dataSource.register(BamDataSource)
    got = [tuple(r[c] for c in ("read_id", "flag", "chrom", "position", "cigar", "seq", "nm", "meth_state")) for r in spark.read.format("bam").option("split_bytes", split).load(str(path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [3, 12])
def test_records_longer_than_a_range(tmp_path, n):
    from strandweave.sources.bam import BamReader

    rnd = random.Random(n)
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 10**6)
    for i in range(n):
        seq = "".join(rnd.choices("ACGT", k=150_000 if i % 3 else 50))
        data += record(f"r{i}", 0, 0, i, [(len(seq), "M")], seq, b"")
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(block(data[i : i + 20000]) for i in range(0, len(data), 20000)) + block(b""))
    reader = BamReader({"path": str(path), "split_bytes": "60000"})
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [f"r{i}" for i in range(n)]

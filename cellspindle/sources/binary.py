"""Sources that are no lines: FASTQ/FASTA records and BAM files, read in a stream by one task per file; BAM files are written too."""

from __future__ import annotations

import gzip
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

BATCH = 20_000
INTEGER = re.compile(r"0|-?[1-9][0-9]{0,8}")
CIGAR = re.compile(r"([0-9]+)([MIDNSHPX=])")


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_stream(name, compression=None)


def _paths(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], f"file_no int, {column} string").repartition(max(1, len(paths)), "file_no")


def _records(path: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, quality) of FASTQ or FASTA, plain or gzip; FASTA sequences may span lines."""
    raw = _open(path)
    head = raw.read(2)
    raw.close()
    raw = _open(path)
    lines = (x.decode("utf-8", "replace").rstrip("\r\n") for x in (gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else raw))
    name, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts), None
            name, parts = line[1:], []
        elif line.startswith("@") and name is None:
            seq = next(lines, "")
            plus = next(lines, "")
            qual = next(lines, None)
            if not plus.startswith("+") or qual is None or len(qual) != len(seq):
                raise ValueError(f"broken record {line[:80]!r} in {path}")
            yield line[1:], seq, qual
        elif name is not None:
            parts.append(line)
        elif line:
            raise ValueError(f"no record at {line[:80]!r} in {path}")
    if name is not None:
        yield name, "".join(parts), None
    raw.close()


def fastq(spark: SparkSession, mates: Sequence[Sequence[str]], interleaved: bool = False) -> DataFrame:
    """(file_no, record_no, name, r1_seq, r1_qual, ... for each mate) of FASTQ or FASTA files.

    ``mates`` holds one list of files per mate, in the same order; with ``interleaved`` the two mates alternate in the
    files of one list. Names must agree up to a final `/1` and what follows white space. Each file (set) is one task,
    read in a stream; repartition for what follows.
    """
    if len({len(m) for m in mates}) != 1:
        raise ValueError("every mate needs the same number of files")
    k = 2 if interleaved else len(mates)
    fields = [f"r{i}_{x}" for i in range(1, k + 1) for x in ("seq", "qual")]
    schema = ", ".join(["file_no int", "record_no long", "name string", *[f"{f} string" for f in fields]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                streams = [_records(p) for p in joined.split("\t")]
                if interleaved:
                    streams = [streams[0], streams[0]]
                out: list[list] = [[] for _ in range(3 + len(fields))]
                record = 0
                while True:
                    group = [next(s, None) for s in streams]
                    if all(g is None for g in group):
                        break
                    if any(g is None for g in group):
                        raise ValueError(f"mates end at different records: {joined}")
                    names = {_bare(g[0]) for g in group}
                    if len(names) > 1:
                        raise ValueError(f"names differ: {sorted(names)}")
                    out[0].append(no)
                    out[1].append(record)
                    out[2].append(_whole(group[0][0]))
                    for i, g in enumerate(group):
                        out[3 + 2 * i].append(g[1])
                        out[4 + 2 * i].append(g[2])
                    record += 1
                    if len(out[0]) == BATCH:
                        yield _batch(out, fields)
                        out = [[] for _ in out]
                if out[0]:
                    yield _batch(out, fields)

    return _paths(spark, ["\t".join(p) for p in zip(*mates, strict=True)], "paths").mapInArrow(rows, schema)


def _batch(out: list[list], fields: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *[pa.array(x, pa.string()) for x in out[2:]]]
    return pa.RecordBatch.from_arrays(arrays, names=["file_no", "record_no", "name", *fields])


def _whole(name: str) -> str:
    first = name.split(None, 1)[0] if name.split() else ""
    return first[:-2] if first[-2:] in ("/1", "/2", "/3", "/4") else first


def _bare(name: str) -> str:
    return _whole(name).split("|||")[0]


class _Blocks:
    """Decompressed bytes of a BGZF file, block after block."""

    def __init__(self, stream):
        self.stream, self.left, self.at = stream, b"", 0

    def read(self, n: int) -> bytes:
        while len(self.left) - self.at < n:
            head = self.stream.read(18)
            if len(head) < 18:
                break
            extra = struct.unpack("<H", head[10:12])[0]
            size = struct.unpack("<H", head[16:18])[0] + 1
            if extra != 6 or head[12:14] != b"BC":
                raise ValueError("not a block-compressed file")
            body = self.stream.read(size - 18)
            self.left, self.at = self.left[self.at :] + zlib.decompress(body[:-8], -15), 0
        out = self.left[self.at : self.at + n]
        self.at += len(out)
        return out

    def integer(self) -> int | None:
        raw = self.read(4)
        return struct.unpack("<i", raw)[0] if len(raw) == 4 else None


_FIXED = {b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I", b"f": "f"}


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at + 3 <= len(data):
        key, kind = data[at : at + 2].decode(), data[at + 2 : at + 3]
        at += 3
        if kind == b"A":
            value, at = chr(data[at]), at + 1
        elif kind in b"ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == b"B":
            code, n = _FIXED[data[at : at + 1]], struct.unpack_from("<I", data, at + 1)[0]
            items = struct.unpack_from(f"<{n}{code}", data, at + 5)
            value, at = data[at : at + 1].decode() + "".join(f",{x:g}" if code == "f" else f",{x}" for x in items), at + 5 + n * struct.calcsize(code)
        else:
            code = _FIXED[kind]
            x = struct.unpack_from("<" + code, data, at)[0]
            value, at = (f"{x:g}" if code == "f" else str(x)), at + struct.calcsize(code)
        out.append((key, value))
    return out


ALIGNMENT = "file_no int, aln_id long, qname string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


def bam(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Alignment rows of BAM files, columns as in SAM text (1-based pos, null for unmapped); aln_id is unique."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in ALIGNMENT.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            for no, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                with _open(path) as stream:
                    for i, record in enumerate(_alignments(_Blocks(stream))):
                        out.append((no, no << 40 | i, *record))
                        if len(out) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return _paths(spark, paths, "path").mapInArrow(rows, ALIGNMENT)


def _alignments(blocks: _Blocks) -> Iterator[tuple]:
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(blocks.integer())
    contigs = []
    for _ in range(blocks.integer()):
        contigs.append(blocks.read(blocks.integer())[:-1].decode())
        blocks.read(4)
    while (size := blocks.integer()) is not None:
        d = blocks.read(size)
        tid, pos, n_name, mapq, _, n_cigar, flag, length, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHIiii", d)
        at = 32
        qname = d[at : at + n_name - 1].decode()
        at += n_name
        ops = struct.unpack_from(f"<{n_cigar}I", d, at)
        at += 4 * n_cigar
        packed = d[at : at + (length + 1) // 2]
        at += (length + 1) // 2
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:length] or "*"
        quals = d[at : at + length]
        at += length
        qual = "*" if not length or quals[0] == 255 else bytes(q + 33 for q in quals).decode()
        cigar = "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or None
        mate = "*" if mtid < 0 else "=" if mtid == tid else contigs[mtid]
        yield qname, flag, contigs[tid] if tid >= 0 else None, pos + 1 if pos >= 0 else None, mapq, cigar, mate, mpos + 1, tlen, seq, qual, _tags(d[at:])


BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
BLOCK = 0xFF00  # bytes of text in a block


def _packed(block: bytes) -> bytes:
    """One block of a BGZF file; the empty one ends the file."""
    c = zlib.compressobj(2, zlib.DEFLATED, -15)
    body = c.compress(block) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
    return head + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(block), len(block))


def _encoded_tags(tags) -> bytes:
    out = b""
    for key, value in sorted(tags or ()):
        if value is None or len(key) != 2:
            continue
        if INTEGER.fullmatch(value):
            out += key.encode() + b"i" + struct.pack("<i", int(value))
        else:
            out += key.encode() + b"Z" + value.encode() + b"\0"
    return out


def _bin(lo: int, hi: int) -> int:
    """Number of the smallest bin that holds [lo, hi): five levels, each of bins an eighth as wide as those above."""
    hi -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == hi >> shift:
            return first + (lo >> shift)
    return 0


def _record(row: dict, numbers: dict[str, int]) -> bytes:
    name = (row["qname"] or "*").encode()[:254] + b"\0"
    ops = [(int(n), OPS.index(o)) for n, o in CIGAR.findall(row["cigar"] or "")]
    seq = row["seq"] if row["seq"] and row["seq"] != "*" else ""
    digits = [max(BASES.find(c), 0) if c == "=" else BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) & 1)
    qual = row["qual"] or "*"
    quals = bytes(ord(c) - 33 for c in qual) if len(qual) == len(seq) and qual != "*" else b"\xff" * len(seq)
    tid = numbers.get(row["chrom"], -1)
    pos = (row["pos"] or 0) - 1
    span = sum(n for n, o in ops if OPS[o] in "MDN=X") or 1
    mate = tid if row["rnext"] == "=" else numbers.get(row["rnext"], -1)
    mapq = 255 if row["mapq"] is None else row["mapq"]
    core = (tid, pos, len(name), mapq, _bin(pos, pos + span) if pos >= 0 else 4680, len(ops), row["flag"] or 0, len(seq), mate, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body = struct.pack("<iiBBHHHIiii", *core) + name + struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops))
    body += bytes(a << 4 | b for a, b in zip(digits[::2], digits[1::2], strict=True)) + quals + _encoded_tags(row["tags"])
    return struct.pack("<i", len(body)) + body


def write_bam(df: DataFrame, folder: str, contigs: DataFrame, most: int = 1_000_000) -> None:
    """A folder of BAM files, one for each partition, all with the same header; columns as in ``bam``.

    ``contigs`` (chrom, length) is the header, at most ``most`` rows; reads on other contigs are written as unplaced.
    Integer tags are typed i, others Z; letters that are no base become N; a quality of another length than the sequence
    is left out. Every task writes a file of its own name, and only those of tasks that counted are moved into place,
    so that tasks run twice leave nothing behind.
    """
    spark = df.sparkSession
    known = contigs.orderBy("chrom").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} contigs")
    numbers = {r.chrom: i for i, r in enumerate(known)}
    text = "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{r.chrom}\tLN:{r.length}\n" for r in known)
    head = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(known))
    for r in known:
        head += struct.pack("<i", len(r.chrom.encode()) + 1) + r.chrom.encode() + b"\0" + struct.pack("<i", r.length)
    header = spark.sparkContext.broadcast((head, numbers))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    target = files.makeQualified(path).toString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids = header.value
        name = f"_writing-{uuid.uuid4().hex}"
        where, base = fs.FileSystem.from_uri(target)
        with where.open_output_stream(f"{base}/{name}") as out:
            held = first
            for batch in batches:
                for row in batch.to_pylist():
                    held += _record(row, ids)
                    while len(held) >= BLOCK:
                        out.write(_packed(held[:BLOCK]))
                        held = held[BLOCK:]
            if held:
                out.write(_packed(held))
            out.write(_packed(b""))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    columns = ALIGNMENT.split(", ")[2:]
    done = df.select(*[c.split()[0] for c in columns]).mapInArrow(rows, "file string").collect()  # one row a partition
    for i, r in enumerate(sorted(x.file for x in done)):
        files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{r}"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/part-{i:05d}.bam"))
    for f in files.listStatus(path):
        if f.getPath().getName().startswith("_writing-"):
            files.delete(f.getPath(), False)

"""Media columns: signature sniffing, correcting declared types, carving embedded media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob. Each hit is only a candidate: the
format's validator walks the structure from there (chunk lengths, checksums, header fields) and returns the true length, or
nothing. The media at offset 0 gives the type, whatever was declared; valid media elsewhere are carved. All of it is narrow
work on single rows in Arrow batches; nothing is shuffled.

Very long or hostile blobs: validators remember, for a blob, from where no walk can succeed, so magic bytes repeated without end
cost time in proportion to the blob (for WAV with a logarithm). Two checks are made anew for every signature, as they depend on
where it stands: a PNG chunk's checksum and a gzip stream; neither signature can occur in UTF-8 text.

store_payload() is the other direction: it keeps arbitrary bytes losslessly as 8-bit samples of a WAV, BMP or PNG.

Defined results: a null blob or text counts as empty. An empty blob has no type. Equal inputs give equal results. Columns of
sniff()'s input stay; one that has the name of a result is replaced. Other columns of documents are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
UNIT = SIDE * SIDE

_PGM = re.compile(rb"P5\s{1,8}(\d{1,6})\s{1,8}(\d{1,6})\s{1,8}255\s")

# ---- validators: (blob, start, memo of this blob and format) -> length of the valid media there, or 0


class Chunks:
    """Chains of RIFF chunks in a blob. Where one begins the next is given, so chains form trees; a node knows its depth, a jump towards the root, and what lies on the way there."""

    def __init__(self, b: bytes) -> None:
        self.b = b
        self.nodes: dict[int, tuple[int, int, int, int, int, int]] = {}  # parent, depth, jump; and up to the root: fmt chunks, data chunks, bad ones

    def add(self, p: int) -> None:
        path = []
        while p not in self.nodes:
            n = struct.unpack_from("<I", self.b, p + 4)[0] if p + 8 <= len(self.b) else -1
            after = p + 8 + n + n % 2
            if n < 0 or p + 8 + n > len(self.b):
                self.nodes[p] = (p, 0, p, 0, 0, 0)
            else:
                path.append((p, n, after))
                p = after
        for q, n, after in reversed(path):
            _, depth, jump, fmt, data, bad = self.nodes[after]
            over = self.nodes[jump][2]
            equal = depth - self.nodes[jump][1] == self.nodes[jump][1] - self.nodes[over][1]
            kind = self.b[q : q + 4]
            self.nodes[q] = (after, depth + 1, over if equal else after, fmt + (kind == b"fmt "), data + (kind == b"data"), bad + (kind == b"fmt " and n < 16))

    def ancestor(self, p: int, depth: int) -> int:
        while (node := self.nodes[p])[1] > depth:
            p = node[2] if self.nodes[node[2]][1] >= depth else node[0]
        return p

    def whole(self, p: int, end: int) -> bool:
        """Whether the chunks from p on end at end, the last one's pad byte aside, and among them are a format and data."""
        self.add(p)
        for q in (end, end + 1):
            if q in self.nodes and self.nodes[q][1] < self.nodes[p][1] and self.ancestor(p, self.nodes[q][1]) == q:
                last = self.ancestor(p, self.nodes[q][1] + 1)
                fmt, data, bad = (x - y for x, y in zip(self.nodes[p][3:], self.nodes[q][3:], strict=True))
                return fmt > 0 and data > 0 and not bad and (q == end or (q - last) % 2 == 0 and struct.unpack_from("<I", self.b, last + 4)[0] % 2 == 1)
        return False


def _wav(b: bytes, at: int, memo: dict) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    return end - at if memo.setdefault("chunks", Chunks(b)).whole(at + 12, end) else 0


def _png(b: bytes, at: int, memo: dict) -> int:
    p, path = at + 8, []
    while p + 12 <= len(b) and p not in memo:
        path.append(p)
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (p == at + 8 and (kind != b"IHDR" or n != 13)):
            break
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            break
        p += 12 + n
        if kind == b"IEND":
            return p - at
    memo.update(dict.fromkeys(path[1:]))  # the first may be no header, and a chunk all the same
    return 0


def _bmp(b: bytes, at: int, memo: dict) -> int:
    if len(b) < at + 54:
        return 0
    total, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits, compression = struct.unpack_from("<iiHHI", b, at + 18)
    if zero or header != 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or compression or width <= 0 or not height:
        return 0
    row = (width * bits + 31) // 32 * 4
    return total if total == offset + row * abs(height) and at + total <= len(b) else 0


def _gif(b: bytes, at: int, memo: dict) -> int:
    """memo: places from which a walk failed; one inside a run of blocks is kept as its complement."""
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or len(b) < at + 14:
        return 0
    p, inside, path = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0), False, []
    while p < len(b) and (state := ~p if inside else p) not in memo:
        path.append(state)
        if inside:
            inside = b[p] > 0
            p += 1 + b[p]
        elif b[p] == 0x3B:
            return p + 1 - at
        elif b[p] == 0x21:
            p, inside = p + 2, True
        elif b[p] == 0x2C and p + 10 < len(b):
            p, inside = p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0), True
        else:
            break
    memo.update(dict.fromkeys(path))
    return 0


def _jpeg(b: bytes, at: int, memo: dict) -> int:
    """memo: places, and whether a frame was met before, from which a walk failed; at "end" the first place from which no end was found."""
    p, frame, path = at + 2, False, []
    while p + 4 <= len(b) and b[p] == 0xFF and (p, frame) not in memo:
        path.append((p, frame))
        kind = b[p + 1]
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        frame |= 0xC0 <= kind <= 0xC2
        if kind == 0xDA:
            if frame and p < memo.get("end", len(b)):
                end = b.find(b"\xff\xd9", p)
                if end >= 0:
                    return end + 2 - at
                memo["end"] = p
            break
    memo.update(dict.fromkeys(path))
    return 0


def _gzip(b: bytes, at: int, memo: dict) -> int:
    d = zlib.decompressobj(31)
    try:
        left = memoryview(b)[at:]
        while left and not d.eof:  # bounded: output is dropped as it comes
            d.decompress(left[: 1 << 16] if not d.unconsumed_tail else d.unconsumed_tail, 1 << 20)
            if not d.unconsumed_tail:
                left = left[1 << 16 :]
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) - len(left) if d.eof else 0


def _pgm(b: bytes, at: int, memo: dict) -> int:
    m = _PGM.match(b, at)
    n = m.end() - at + int(m[1]) * int(m[2]) if m else 0
    return n if n and m.end() < at + n <= len(b) else 0


#: kind: magic bytes, validator
FORMATS: dict[str, tuple[bytes, Callable[[bytes, int, dict], int]]] = {
    "audio/wav": (b"RIFF", _wav),
    "image/png": (b"\x89PNG\r\n\x1a\n", _png),
    "image/bmp": (b"BM", _bmp),
    "image/gif": (b"GIF8", _gif),
    "image/jpeg": (b"\xff\xd8\xff", _jpeg),
    "application/gzip": (b"\x1f\x8b\x08", _gzip),
    "image/x-portable-graymap": (b"P5", _pgm),
}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (magic, _) in FORMATS.items():
        out.add_word(magic.decode("latin-1"), (kind, len(magic)))
    out.make_automaton()
    return out


def carve(blob: bytes, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, length) of valid media, leftmost first, none inside another."""
    found, free = [], 0
    memo: dict[str, dict] = {kind: {} for kind in FORMATS}
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(blob.decode("latin-1")))
    for start, kind in hits:
        if start >= free and (length := FORMATS[kind][1](blob, start, memo[kind])):
            found.append((kind, start, length))
            free = start + length
    return found


MEDIA = "kind string, corrected boolean, embedded array<struct<kind:string,start:long,length:long>>"
Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def _sniffer(blob_col: str, declared_col: str) -> Step:
    automaton = _automaton()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        kinds, wrong, inside = [], [], []
        for blob, said in zip(*(batch.column(names.index(c)).to_pylist() for c in (blob_col, declared_col)), strict=True):
            found = carve(blob or b"", automaton)
            own = found[0][0] if found and found[0][1] == 0 else None
            kinds.append(own)
            wrong.append(own is not None and own != said)
            inside.append([{"kind": k, "start": s, "length": n} for k, s, n in found[own is not None :]])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, item)], [*names, "kind", "corrected", "embedded"])

    return step


def sniff(df: DataFrame, blob_col: str, declared_col: str) -> DataFrame:
    """df with kind (null if unknown), corrected (the declared type was wrong) and the embedded media that are not the blob itself."""
    df = df.drop(*({"kind", "corrected", "embedded"} - {blob_col, declared_col}))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _sniffer(blob_col, declared_col)
        for batch in batches:
            yield step(batch)

    return df.mapInArrow(run, f"{schema}, {MEDIA}")


# ---- payloads stored as media


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def store_payload(payload: bytes) -> bytes:
    """The payload as 8-bit samples: mono sound, or grey pixels in rows of 24; its checksum picks the format."""
    n = len(payload)
    pick = zlib.crc32(payload) % 3
    if pick == 0:
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if pick == 1:
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + n, 0, 54 + 1024, 40, SIDE, -(n // SIDE), 1, 8, 0, n, 0, 0, 256, 256)
        return b"BM" + head + grey + payload
    lines = np.zeros((n // SIDE, SIDE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", SIDE, n // SIDE, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_payload(blob: bytes, kind: str) -> bytes:
    """The samples of what store_payload() wrote, found by the stored structure."""
    if kind == "audio/wav":
        at = 12
        while blob[at : at + 4] != b"data":
            at += 8 + struct.unpack_from("<I", blob, at + 4)[0]
        return blob[at + 8 : at + 8 + struct.unpack_from("<I", blob, at + 4)[0]]
    if kind == "image/bmp":
        offset, (width, height) = struct.unpack_from("<I", blob, 10)[0], struct.unpack_from("<ii", blob, 18)
        return blob[offset : offset + width * abs(height)]
    if kind == "image/png":
        at, width, data = 8, 0, b""
        while blob[at + 4 : at + 8] != b"IEND":
            n = struct.unpack_from(">I", blob, at)[0]
            if blob[at + 4 : at + 8] == b"IHDR":
                width = struct.unpack_from(">I", blob, at + 8)[0]
            elif blob[at + 4 : at + 8] == b"IDAT":
                data += blob[at + 8 : at + 8 + n]
            at += 12 + n
        return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
    raise ValueError(kind)


def _stored(batch: pa.RecordBatch, declared: str) -> pa.RecordBatch:
    """batch: ids and texts."""
    made = [padded(t) for t in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([store_payload(p) for p, _ in made], pa.binary()), pa.array([declared] * len(made), pa.string())],
        ["doc_id", "n_bytes", "blob", "declared"],
    )


def _slices(batch: pa.RecordBatch, column: int = 1, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes, so that few blobs are held at once."""
    upto = np.cumsum([len(t or "") for t in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def media_column(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, the stored blob and its declared type, which says nothing yet: sniff() finds the true one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _stored(part, declared)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, blob binary, declared string")


DIGEST = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What is read back of sniffed media: sizes, hashes and features of the samples."""
    rows = []
    for blob, kind, corrected, inside in zip(*(batch.column(c).to_pylist() for c in ("blob", "kind", "corrected", "embedded")), strict=True):
        payload = read_payload(blob, kind)
        hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        n, total = len(payload), int((hist * np.arange(256)).sum())
        feature = f"{kind};corrected={int(corrected)};embedded={len(inside)};samples={n};sum={total};distinct={int((hist > 0).sum())};mode={int(hist.argmax())}"
        rows.append((n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def digests(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Each text stored as media, sniffed, read back and digested, in one pass: blobs don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffed = _sniffer("blob", "declared")
        for batch in batches:
            for part in _slices(batch):
                yield _digest(sniffed(_stored(part, declared)))

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST.format(docs.schema["doc_id"].dataType.simpleString()))

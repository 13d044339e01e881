"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

File layout (little-endian throughout):

* frames: each document's ids as unsigned 32-bit integers, one zstandard frame for up
  to ``FRAME_IDS`` ids, with the frame's own content checksum;
* one skippable frame (magic 0x184D2A50) with an entry per document: doc_id (int64),
  is-null flag (uint8), first frame (uint32), number of frames (uint32), ids (uint64);
* one skippable frame (magic 0x184D2A5E), the seek table of the public seekable format:
  compressed size, size, low 32 bits of the content's xxh64 per frame; then number of
  frames, descriptor 0x80, magic 0x8F92EAB1.

A reader takes the tail of the file, finds a document's frames in the two tables and
decompresses those only. Task attempts write files under names of their own; only files
in the manifest, which Spark commits, count, so a lost executor leaves at most a file
that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

FRAME_IDS = 1 << 20
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u4"), ("frames", "<u4"), ("ids", "<u8")])
SEEK_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary's format).
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The character that stands for each byte in the vocabulary: printable ones for themselves, the rest from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = "".join(chr(b) if b in _PRINTED else chr(256 + b - sum(p < b for p in _PRINTED)) for b in range(256))
LONGEST = 256  # characters of a remembered piece
_ENCODERS: dict[int, Encoder] = {}


class Pieces(dict):
    """Ids of pieces that all follow ``lead``, learned as they are met.

    Pieces of Latin letters are cut further, as the pre-tokenizer cuts them, so that a word
    costs its merges once with whatever punctuation follows it. None: the piece begins with
    white space or is empty, so it belongs to the white space before. Pieces of more than
    ``LONGEST`` characters are not kept.
    """

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.before = encoder, lead, {}

    def turn(self) -> None:
        """Start anew; what was known is learned from memory once more."""
        self.before = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes | None:
        lead, encoder = self.lead, self.encoder
        if piece in self.before:
            ids = self.before[piece]
        elif lead and (not piece or piece[0].isspace()):
            ids = None
        elif piece.isascii() or max(piece) < "\u0250":
            cut = [] if piece.isalpha() else _CUT.findall(lead + piece)
            ids = encoder.one(lead + piece) if len(cut) < 2 else b"".join([encoder.cut(c) for c in cut])
        else:
            ids = encoder.plain(lead + piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    """Byte-level BPE of whole texts with every distinct piece encoded once.

    A single space between two non-space characters always starts a new piece of the
    pre-tokenizer, so the pieces between such spaces encode independently and can be
    remembered. The tables are bounded by ``limit`` pieces: at half of it they become the ones
    before, which answer until the next turn. Texts that contain an added token
    of the vocabulary go through the tokenizer whole, as it cuts these out first.
    """

    def __init__(self, tokenizer_json: bytes, end_id: int | None, limit: int = 1_600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens") or () if t["content"]]
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.limit, self.first, self.rest = limit, Pieces(self, ""), Pieces(self, " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes, with the end id appended."""
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(self.plain(t) + self.end)
            else:
                out.append(self._join(t.split(" ")) if t else self.end)
            if len(self.rest) + len(self.first) > self.limit // 2:
                self.first.turn()
                self.rest.turn()
        return out

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(piece.encode().decode("latin-1").translate(_BYTES))])

    def cut(self, piece: str) -> bytes:
        return self.rest[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.first[piece] if piece.isalpha() else self.one(piece)

    def _join(self, cut: list[str]) -> bytes:
        try:
            return b"".join((self.first[cut[0]], *map(self.rest.__getitem__, cut[1:]), self.end))
        except TypeError:  # a run of white space: cut only between a space and what is not white space on both sides
            cut = _SPLIT.split(" ".join(cut))
            return b"".join((self.first[cut[0]], *map(self.rest.__getitem__, cut[1:]), self.end))


def _encoder(tokenizer_json: bytes, end_id: int | None) -> Encoder:
    key = hash((tokenizer_json, end_id))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json, end_id)
    return _ENCODERS[key]


@lru_cache(maxsize=4)
def _press(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)


def pack(ids: bytes, level: int = 3) -> tuple[bytes, list[int], list[int], list[int]]:
    """Frames of one document, and each frame's packed size, size and checksum."""
    press, frames, sizes, checks = _press(level), [], [], []
    for at in range(0, len(ids), 4 * FRAME_IDS):
        part = ids[at : at + 4 * FRAME_IDS]
        frames.append(press.compress(part))
        sizes.append(len(part))
        checks.append(xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
    return b"".join(frames), [len(f) for f in frames], sizes, checks


def frames_of(docs: DataFrame, tokenizer_json: bytes, end_id: int | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and compress each document: doc_id, body, packed, sizes, checks."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(shared.value, end_id)
        for b in batches:
            keys, texts, at = b["doc_id"].to_pylist(), b["text"], 0
            while at < len(keys):
                part, size, upto = [], 0, at
                while upto < len(keys) and size < 4_000_000 and upto - at < 2000:
                    t = texts[upto].as_py() or ""
                    part.append(t)
                    size += len(t)
                    upto += 1
                packed = [pack(x) for x in encoder.encode(part)]
                yield {"doc_id": keys[at:upto], **{n: [p[i] for p in packed] for i, n in enumerate(("body", "packed", "sizes", "checks"))}}
                at = upto

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(src, run, "doc_id long, body binary, packed array<long>, sizes array<long>, checks array<long>")


def tail(index: np.ndarray, seek: np.ndarray) -> bytes:
    entries = index.tobytes()
    table = seek.tobytes() + struct.pack("<IBI", len(seek), 0x80, FOOTER_MAGIC)
    return struct.pack("<II", INDEX_MAGIC, len(entries)) + entries + struct.pack("<II", SEEK_MAGIC, len(table)) + table


def write_files(frames: DataFrame, folder: str) -> DataFrame:
    """Write one file per range of doc_id, ascending (nulls first); returns the stored manifest.

    Equal doc_ids are ordered by their frames' bytes. Manifest: part (files in doc_id
    order), path, documents, ids.
    """
    key = F.xxhash64("body")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, out, path, index, seek, ids = TaskContext.get().partitionId(), None, "", [], [], 0
        for b in batches:
            keys, packed, lengths, checks = (b[n].to_pylist() for n in ("doc_id", "packed", "sizes", "checks"))
            for d, p, sizes, c, body in zip(keys, packed, lengths, checks, b["body"], strict=True):
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                    out = fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                index.append((d or 0, d is None, len(seek), len(sizes), sum(sizes) // 4))
                seek += zip(p, sizes, c, strict=True)
                ids += index[-1][4]
                out.write(body.as_buffer())
        if out is not None:
            out.write(tail(np.array(index, INDEX_ENTRY), np.array(seek, SEEK_ENTRY)))
            out.close()
            yield {"part": [part], "path": [path], "documents": [len(index)], "ids": [ids]}

    ranged = frames.withColumn("_tie", key).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    return materialise(arrow_map(ranged.drop("_tie"), run, "part int, path string, documents long, ids long"), "token-manifest")


class TokenFile:
    """Random access to one file: reads the tail, then only the frames asked for."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file, self.unpack = fs.open_input_file(name), zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError(f"{path}: no seek table")
        start = end - 9 - count * SEEK_ENTRY.itemsize
        self.seek = np.frombuffer(self._at(start, count * SEEK_ENTRY.itemsize), SEEK_ENTRY)
        body = int(self.seek["packed"].astype(np.int64).sum())
        magic, size = struct.unpack("<II", self._at(body, 8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path}: no document index")
        self.index = np.frombuffer(self._at(body + 8, size), INDEX_ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset) if size else b""

    def ids(self, row: int) -> np.ndarray:
        """The ids of the ``row``-th document of the file; every checksum is verified."""
        entry, parts = self.index[row], []
        for f in range(int(entry["first"]), int(entry["first"]) + int(entry["frames"])):
            raw = self.unpack(self._at(int(self.offsets[f]), int(self.seek["packed"][f])))
            if len(raw) != self.seek["size"][f] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["check"][f]:
                raise ValueError(f"frame {f}: wrong checksum")
            parts.append(raw)
        return np.frombuffer(b"".join(parts), "<u4")

    def close(self) -> None:
        self.file.close()


def read_files(manifest: DataFrame, digest: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of the manifest's files: doc_id, start, n_tokens, and ids or (``digest``) ids_crc32.

    ``wanted``: (path, rows array<int>) picks documents of a file by their place in its
    index; all by default. ``start`` counts the ids of all documents before, over all files.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))  # one row per file
    files = files.join(wanted, "path") if wanted is not None else files.withColumn("rows", F.lit(None).cast("array<int>"))
    last = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path, base, rows in zip(b["path"].to_pylist(), b["base"].to_pylist(), b["rows"].to_pylist(), strict=True):
                f = TokenFile(path)
                starts = base + np.concatenate([[0], np.cumsum(f.index["ids"].astype(np.int64))])
                rows = range(len(f.index)) if rows is None else rows
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512]
                    ids = [f.ids(r) for r in some]
                    yield {
                        "doc_id": [None if f.index["null"][r] else int(f.index["doc_id"][r]) for r in some],
                        "start": [int(starts[r]) for r in some],
                        "n_tokens": [len(x) for x in ids],
                        last.split()[0]: [zlib.crc32(x.tobytes()) for x in ids] if digest else [x.astype(np.int64) for x in ids],
                    }
                f.close()

    return arrow_map(files.repartition(max(1, manifest.count()), "path"), run, f"doc_id long, start long, n_tokens long, {last}")


def write_tokens(docs: DataFrame, tokenizer_json: bytes, end_id: int | None, folder: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write their token files; returns the manifest.

    Null text counts as empty: with an end id a document of one id, without one a document
    of no frames. Empty input writes no file. Other columns are ignored; rows with equal
    doc_id are all written.
    """
    return write_files(materialise(frames_of(docs, tokenizer_json, end_id, doc, text), "token-frames"), folder)

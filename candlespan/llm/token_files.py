"""Token ids in seekable zstandard files.

A shard file is a row of independent zstandard frames, each with a content checksum and holding the ids of whole documents as
little-endian unsigned 32-bit integers; then, in skippable frames that any zstandard reader passes over, a compressed directory
of the documents and the seek table of the public seekable format: sizes of each frame and the low 32 bits of the XXH64 of its
content. A reader opens the tail of a file, finds the frame of a document and decompresses that one only.

    frame ... frame | directory (skippable) | seek table (skippable, ends in the frame count, a flag byte and the magic number)
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyarrow import fs

#: Fixed values of the seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_DIRECTORY = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
LEVEL = 1
#: One document of the directory; `known` is 0 for a null doc_id.
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8"), ("crc32", "<u4")])


class ShardWriter:
    """Writes documents in the order given. The file appears under its name when it is closed, whole or not at all."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES):
        self.store, self.path = fs.FileSystem.from_uri(path)
        # a task may run twice; each attempt writes aside and the last one to finish is moved into place
        self.aside = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.aside)
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.entries: list[tuple] = []
        self.parts: list[bytes] = []
        self.filled = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes, crc32: int) -> None:
        self.entries.append((doc_id or 0, doc_id is not None, len(self.frames), self.filled, len(ids) // 4, crc32))
        self.parts.append(ids)
        self.filled += len(ids)
        self.n_tokens += len(ids) // 4
        if self.filled >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            content = b"".join(self.parts)
            packed = self.packer.compress(content)
            self.out.write(packed)
            self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.parts, self.filled = [], 0

    def close(self) -> int:
        """The number of tokens written."""
        self._flush()
        directory = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(np.array(self.entries, ENTRY).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(directory)) + directory)
        # the directory has an entry of its own, with no content, so that the offsets of the seek table cover it
        rows = [*self.frames, (len(directory) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *r) for r in rows) + struct.pack("<IBI", len(rows), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.store.move(self.aside, self.path)
        return self.n_tokens


class ShardReader:
    """Reads documents of one shard; only the frames asked for are read and decompressed."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        rows = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.frames = rows[:-1]
        self.starts = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
        raw = self._at(int(self.starts[-2]), int(rows[-1, 0]))
        if struct.unpack("<I", raw[:4])[0] != SKIPPABLE_DIRECTORY:
            raise ValueError(f"{path} has no directory")
        self.entries = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(raw[8:]), ENTRY)
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            size, full, checksum = map(int, self.frames[k])
            content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), size), max_output_size=full)
            if len(content) != full or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, content)
        return self._held[1]

    def tokens(self, place: int) -> np.ndarray:
        """The ids of the document at `place` of the directory."""
        e = self.entries[place]
        return np.frombuffer(self.frame(int(e["frame"])), "<u4", int(e["n_tokens"]), int(e["offset"]))

    def documents(self) -> Iterator[tuple[int, int]]:
        """(number of ids, their crc32) of each document in turn, each frame decompressed once."""
        e = self.entries
        for frame, offset, n in zip(e["frame"].tolist(), e["offset"].tolist(), e["n_tokens"].tolist()):
            ids = memoryview(self.frame(frame))[offset : offset + 4 * n]
            yield len(ids) // 4, zlib.crc32(ids)

    def find(self, doc_id: int | None) -> list[int]:
        """The places of a document, none if it is elsewhere."""
        known = self.entries["known"] == (doc_id is not None)
        return np.flatnonzero(known & (self.entries["doc_id"] == (doc_id or 0))).tolist()


def make_folder(path: str) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name, recursive=True)



"""Token ids in flat binary files with 64-bit document offsets."""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from skyfold.llm import lex
from skyfold.llm.store import prepare, columns, folder

MAGIC = b"SKYTOK01"
HEADER = "<8sIIQQ"  # magic, bytes of an id, reserved, documents, ids
HEADER_BYTES = struct.calcsize(HEADER)
PIECE_CACHE = 600_000  # of some 200 bytes each in a worker
ENCODE_BYTES = (2 << 20) - 2  # of a slice: the more text, the fewer distinct pieces a byte
_LETTER = ((lex._byte >= 0x41) & (lex._byte <= 0x5A)) | ((lex._byte >= 0x61) & (lex._byte <= 0x7A))
_SPACE = ~lex.SPACED
#: After a cut blank: no white space, and no byte that may begin a wider white space.
_AFTER = ~(_SPACE | np.isin(lex._byte, [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]))
_MARK = np.isin(lex._byte, [ord(c) for c in ".,;:!?"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_map() -> list[str]:
    """Characters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes many texts with the tokenizers library, each distinct piece of a batch once.

    With byte-level pre-tokenising by the usual pattern, a text may be cut before a blank that a word follows and before a mark after a
    letter without changing any token.  Distinct pieces are kept, so a common word meets the library once.  Pieces that are one letter
    run go straight to the library's model; all others through its whole ``encode_batch``.  Other tokenizers take whole texts.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        added = spec.get("added_tokens", ())
        self.pieces = self.pieces and all(t["content"] and not t["lstrip"] and not t["rstrip"] and not t.get("normalized") and not re.search(r"[\s.,;:!?]", t["content"]) for t in added)
        self.after = _AFTER & ~np.isin(lex._byte, [t["content"].encode()[0] for t in added])
        self.map = byte_map()
        # a piece that is a blank at most and then letters is one pre-token
        self.one = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
        self.known: dict[bytes, bytes] = {}
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32

    def _new(self, pieces: list[bytes]) -> None:
        whole = []
        model, table = self.tok.model, self.map
        if len(self.known) + len(pieces) > PIECE_CACHE:
            self.known.clear()
        for p in pieces:
            s = p.decode()
            if self.one.fullmatch(s):
                self.known[p] = np.array([t.id for t in model.tokenize("".join([table[b] for b in p]))], self.kind).tobytes()
            else:
                whole.append((p, s))
        for (p, _), e in zip(whole, self.tok.encode_batch([s for _, s in whole], add_special_tokens=False)):
            self.known[p] = np.array(e.ids, self.kind).tobytes()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        if not self.pieces:
            got = self.tok.encode_batch([buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)
            counts = np.array([len(e.ids) for e in got], np.int64)
            return np.concatenate([np.array(e.ids, self.kind) for e in got]) if n else np.zeros(0, self.kind), counts
        space = buf == 0x20
        cut = np.zeros(len(buf) + 1, bool)
        cut[:-2] = space[:-1] & self.after[buf[1:]]
        cut[off[1:] - 1] = False
        letter = _LETTER[buf]
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:-1] |= _MARK[buf[1:]] & letter[:-1]
        line = buf == 0x0A
        alone = line[1:-1] & ~_SPACE[buf[:-2]] & self.after[buf[2:]]
        cut[1:-2] |= alone
        cut[2:-1] |= alone
        cut[off] = True
        at = np.flatnonzero(cut)
        spans = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = spans.dictionary_encode()
        idx = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.known]
        if len(self.known) + len(fresh) > PIECE_CACHE:
            fresh = distinct
        if fresh:
            self._new(fresh)
        parts = [self.known[p] for p in distinct]
        flat = np.frombuffer(b"".join(parts), self.kind)
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        base = np.concatenate([[0], np.cumsum(lens)])
        size = lens[idx]
        ends = np.cumsum(size)
        out = flat[np.arange(ends[-1]) + np.repeat(base[idx] - (ends - size), size)]
        upto = np.concatenate([[0], ends])
        return out, np.diff(upto[np.searchsorted(at, off)])


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files in ascending doc_id order; returns the small table of parts.

    Rows are range-partitioned by doc_id; a task encodes its rows in order, ``end_id`` after each document, and writes
    ``<out>/<part>.ids`` (header, flat little-endian ids, 16-bit if the vocabulary fits) and ``<out>/<part>.off`` (64-bit ends of the
    documents in ids, and doc_ids).  ``base`` of the returned ``part, base, n_docs, n_ids, path`` is the prefix sum of ids.  A task that
    runs again writes its own files anew; the table names the files of the run that counted.

    Null texts are empty (one id); rows with equal doc_id are ordered by text hash, null ids come first (kept as null); an empty table
    writes no file.  Other columns are ignored.
    """
    columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = encoder(path), uuid.uuid4().hex
        ids, ends, keys, total, first = [], [], [], 0, None
        stream = None
        system, top = _open(out)
        end = np.array([end_id], own.kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                system.create_dir(top)
                stream = system.open_output_stream(f"{top}/{name}.ids")
                stream.write(struct.pack(HEADER, MAGIC, own.width, 0, 0, 0))
                k = batch.column("doc_id")[0].as_py()
                first = -(1 << 63) if k is None else k
            keys.append(np.array([-(1 << 63) if k is None else k for k in batch.column("doc_id").to_pylist()], "<i8"))
            buf, off = lex.raw(batch.column("text"))
            for _, _, part, offs in lex.slices(buf, off, ENCODE_BYTES):
                got, counts = own.encode(part, offs)
                got = np.insert(got, np.cumsum(counts), end)
                stream.write(got.astype(f"<u{own.width}").tobytes())
                ends.append(total + np.cumsum(counts + 1))
                total += len(got)
        if stream is not None:
            stream.close()
            every = np.concatenate(ends).astype("<i8")
            with system.open_output_stream(f"{top}/{name}.off") as f:
                f.write(struct.pack(HEADER, MAGIC, own.width, 0, len(every), total) + every.tobytes() + np.concatenate(keys).tobytes())
            yield pa.RecordBatch.from_pydict({"first": [first], "last": [int(keys[-1][-1])], "n_docs": [len(every)], "n_ids": [total], "path": [f"{out}/{name}"]}, pa.schema([("first", pa.int64()), ("last", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("path", pa.string())]))

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "first long, last long, n_docs long, n_ids long, path string").collect())
    parts, base = [], 0
    for k, (_, _, n_docs, n_ids, at) in enumerate(found):
        parts.append((k, base, n_docs, n_ids, at))
        base += n_ids
    return spark.createDataFrame(parts, "part long, base long, n_docs long, n_ids long, path string")


def mapped(path: str, n_docs: int, width: int, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document ends and doc_ids of one part, memory-mapped where the store is a local folder."""
    system, name = _open(path)
    if isinstance(system, fs.LocalFileSystem):
        ids = np.memmap(f"{name}.ids", f"<u{width}", "r", HEADER_BYTES, (n_ids,))
        tail = np.memmap(f"{name}.off", "<i8", "r", HEADER_BYTES, (2 * n_docs,))
    else:
        with system.open_input_stream(f"{name}.ids") as f:
            ids = np.frombuffer(f.read(), np.uint8)[HEADER_BYTES :].view(f"<u{width}")
        with system.open_input_stream(f"{name}.off") as f:
            tail = np.frombuffer(f.read(), np.uint8)[HEADER_BYTES :].view("<i8")
    return ids, tail[:n_docs], tail[n_docs:]


def header(path: str) -> tuple[int, int, int]:
    """Bytes of an id, documents and ids of a part."""
    system, name = _open(path)
    with system.open_input_stream(f"{name}.off") as f:
        magic, width, _, docs, ids = struct.unpack(HEADER, f.read(HEADER_BYTES))
    if magic != MAGIC:
        raise ValueError(f"{path} is no token file")
    return width, docs, ids


def read_tokens(parts: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, from the files of ``parts``; ``start`` counts over all parts."""
    rows = parts.select("base", "path")
    n = max(1, parts.count())
    rows = rows.repartition(n, "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for base, path in zip(frame["base"], frame["path"]):
                width, n_docs, n_ids = header(path)
                ids, ends, keys = mapped(path, n_docs, width, n_ids)
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, n_docs, 4096):
                    a, b = starts[i : i + 4096], ends[i : i + 4096]
                    out = {"doc_id": keys[i : i + 4096].copy(), "start": base + a, "n_tokens": b - a, "ids_crc32": [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(a, b)]}
                    if with_ids:
                        out["ids"] = [ids[x:y].astype(np.int32) for x, y in zip(a, b)]
                    yield pd.DataFrame(out)

    got = rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return got.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode, write to the shared folder, and read back."""
    return read_tokens(write_tokens(docs, folder(docs.sparkSession, "tokens"), tokenizer))

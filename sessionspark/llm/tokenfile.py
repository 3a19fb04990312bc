"""Token-id files with a shared zstandard dictionary.

A dictionary is trained on a bounded sample: SAMPLE_CHARS characters, at a hashed place, of about SAMPLE_DOCS different
texts that a hash of id and text picks from all, serialized as ids. Documents are sorted by id over range partitions; each task encodes its documents, compresses
the little-endian 32-bit ids of each document on its own, and writes blocks of about BLOCK_BYTES. A block is a row of a
Parquet table: the frames one after the other, their offsets, document ids and token counts, the least and greatest id, the
ids written before it in its partition, and the dictionary's SHA-256. A reader finds a document by its block's id range (which
Parquet's statistics hold too) and slices its frame.

Texts are cut before each space that a non-space follows: byte-level BPE never joins tokens across such a cut, so the
tokenizers library encodes each distinct piece of text once per cache, and a document's ids are gathered from there. The
strings of added tokens (as an end mark) part a text as the library parts it and have their own ids. A piece is looked up
by a 64-bit hash and its bytes are compared; one that shares its hash with other bytes is encoded alone.

Defined cases: a null text is empty and has the end id only; null ids come first; rows with equal ids are ordered by a
hash of the text; an empty table gives an empty file; a very long text is one frame, encoded piece by piece; further
columns, whatever their names, are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textio

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 4096, 1 << 16
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3
#: Row groups are small, so that a reader of few documents passes over most of a file by the statistics of first_id and last_id.
ROW_GROUP_BYTES = 8 << 20

BLOCKS = "part int, block int, first_id long, last_id long, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, start_in_part long, n_ids long, payload binary, dictionary string"


#: Bytes after a space before which a text is cut: ASCII but for white space, and all that cannot begin white space.
_AFTER_CUT = np.ones(256, bool)
_AFTER_CUT[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_AS_IS = np.arange(256, dtype=np.uint8)


class Encoder:
    """Ids of texts by the tokenizers library (added tokens parsed, none added), with a bounded cache of pieces.

    Only pieces of at most LONGEST bytes are kept: below a kilobyte the hash has no structural collisions, and others are found by their bytes.
    """

    CACHE, LONGEST, JOINED, FRESH = 1_000_000, 64, 512, 1 << 18

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()) or not added:
            raise ValueError("added tokens must match their bare strings")
        self.marks = {t.content: i for i, t in added.items()}
        self.mark = max(self.marks)
        self._mark_bytes = re.compile(b"|".join(re.escape(m.encode()) for m in sorted(self.marks, key=len, reverse=True)))
        self._clear()

    def _clear(self) -> None:
        # Hashes and numbers of the pieces kept, sorted by hash: a large table, and a small one of those added of late.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.bytes, self.used_bytes = np.zeros(1 << 20, np.uint8), 0
        self.first, self.length, self.at, self.size = (np.zeros(1 << 18, np.int32) for _ in range(4))
        self.n = 0

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, their begins and counts: many at a time, parted by an added token that none holds."""
        groups = [pieces[i : i + self.JOINED] for i in range(0, len(pieces), self.JOINED)]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        mark_id = self.marks[self.mark]
        for group, e in zip(groups, self.library.encode_batch_fast([self.mark.join([*g, ""]) for g in groups], add_special_tokens=False), strict=True):
            x = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(x == mark_id)
            if len(ends) != len(group):
                raise ValueError("the added token doesn't part the pieces")
            ids.append(np.delete(x, ends))
            counts.append(np.diff(ends, prepend=-1) - 1)
        count = np.concatenate(counts)
        return np.concatenate(ids), np.cumsum(count) - count, count

    def _add(self, text: bytes, starts: np.ndarray, ends: np.ndarray, keep: bool) -> np.ndarray:
        """Store the ids (and, to keep them, the bytes) of pieces; returns their numbers."""
        raw = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, first, count = self._encode([r.decode() for r in raw])
        n = len(raw)
        self.ids = _room(self.ids, self.used + len(flat))
        self.first, self.length, self.at, self.size = (_room(x, self.n + n) for x in (self.first, self.length, self.at, self.size))
        here = slice(self.n, self.n + n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[here], self.length[here] = first + self.used, count
        self.used += len(flat)
        if keep:
            size = ends - starts
            total = int(size.sum())
            self.bytes = _room(self.bytes, self.used_bytes + total)
            self.bytes[self.used_bytes : self.used_bytes + total] = np.frombuffer(b"".join(raw), np.uint8)
            self.at[here], self.size[here] = np.cumsum(size) - size + self.used_bytes, size
            self.used_bytes += total
        self.n += n
        return np.arange(self.n - n, self.n)

    def _hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textio.span_hashes(data, starts, ends, _AS_IS)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        for keys, numbers in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[hit] = numbers[at[hit]]
        return out

    def _keep(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Keep pieces with new hashes (sorted)."""

        def merged(a, b):
            at = np.searchsorted(a[0], b[0])
            return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

        large, small = self.known
        small = merged(small, (h, numbers))
        if len(small[0]) > self.FRESH:
            large, small = merged(large, small), (small[0][:0], small[1][:0])
        self.known = [large, small]

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which pieces have other bytes than those kept under their numbers."""
        size = ends - starts
        wrong = size != self.size[number]
        same = np.flatnonzero(~wrong)
        n = size[same]
        last = np.cumsum(n)
        step = np.arange(int(last[-1]) if len(last) else 0)
        unequal = data[np.repeat(starts[same] - (last - n), n) + step] != self.bytes[np.repeat(self.at[number[same]] - (last - n), n) + step]
        wrong[same[np.searchsorted(last, np.flatnonzero(unequal), "right")]] = True
        return np.flatnonzero(wrong)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece of a text column, and where each row's begin and end."""
        if self.n > self.CACHE:
            self._clear()
        text = data.tobytes()
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & _AFTER_CUT[data[1:]] if len(data) else False
        marked = [m.span() for m in self._mark_bytes.finditer(text)]
        if marked:  # not across rows
            row = np.searchsorted(offsets, [a for a, _ in marked], "right") - 1
            marked = [m for m, r in zip(marked, row.tolist(), strict=True) if m[1] <= offsets[r + 1]]
        full = np.flatnonzero(np.diff(offsets))
        ends = np.concatenate((offsets[full + 1], np.array([a for a, _ in marked], np.int64)))
        cut[np.maximum(ends - 1, 0)] = False  # white space at an end isn't parted from what stands before it
        cut[offsets[full]] = True
        for a, b in marked:
            cut[a:b] = False
            cut[a] = cut[b] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        number = np.zeros(len(starts), np.int64)
        special = np.searchsorted(starts, np.array([a for a, _ in marked], np.int64))
        usual = np.ones(len(starts), bool)
        usual[special] = False
        size = ends - starts
        short, long = np.flatnonzero(usual & (size <= self.LONGEST)), np.flatnonzero(usual & (size > self.LONGEST))
        h, one, same = np.unique(self._hash(data, starts[short], ends[short]), return_index=True, return_inverse=True)
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        found[new] = self._add(text, starts[short[one[new]]], ends[short[one[new]]], True)
        self._keep(h[new], found[new])
        number[short] = found[same]
        other = short[self._others(data, starts[short], ends[short], number[short])]
        alone = np.concatenate((long, other))
        number[alone] = self._add(text, starts[alone], ends[alone], False)
        n, first = self.length[number].astype(np.int64), self.first[number].astype(np.int64)
        if marked:
            own = {i: k for k, i in enumerate(sorted(set(self.marks.values())))}
            self.ids = _room(self.ids, self.used + len(own))
            self.ids[self.used : self.used + len(own)] = list(own)
            n[special], first[special] = 1, [self.used + own[self.marks[text[a:b].decode()]] for a, b in marked]
        last = np.cumsum(n)
        ids = self.ids[np.repeat(first - (last - n), n) + np.arange(int(last[-1]) if len(last) else 0)]
        return ids, np.concatenate(([0], last))[np.searchsorted(starts, offsets)]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        ids, bounds = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a longer copy that has n places."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few samples for training, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _sample_dictionary(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int) -> bytes:
    """A dictionary of about SAMPLE_DOCS documents, each taken where a hash of its id and text is under the share that gives so many; equal ones count once."""
    rows = docs.select(F.col(textio.quoted(key)).alias("k"), F.col(textio.quoted(text)).alias("t")).where("t is not null")
    rows = rows.withColumn("h", F.xxhash64("k", "t", F.lit(9)))
    share = SAMPLE_DOCS / max(1, rows.agg(F.approx_count_distinct("h")).first()[0])
    begin = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    taken = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < share
    picked = rows.where(taken).select("h", F.substring("t", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("t")).dropDuplicates(["h"]).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(tokenizer).encode_texts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([np.append(x, np.uint32(end_id)).astype("<u4").tobytes() for x in ids], pa.binary())], names=["ids"])

    return train_dictionary(sorted(bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect()))


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> bytes:
    """Write the token-id file of all documents in ascending key order; returns the dictionary, which is also stored beside the blocks."""
    spark = docs.sparkSession
    dictionary = _sample_dictionary(docs, key, text, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    key, text = textio.quoted(key), textio.quoted(text)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"), F.col(text).alias("t"))
    rows = rows.repartitionByRange("k", "h", "m").sortWithinPartitions("k", "h", "m").select("k", "t")
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys, counts, frames, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            n = sum(counts)
            held = [k for k in keys if k is not None]
            row = [part, block, min(held, default=None), max(held, default=None), keys, counts, offsets, before - n, n, b"".join(frames), digest]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            data, offsets = textio.utf8(batch.column(1))
            for i, j in textio.pieces(offsets):
                ids, bounds = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    raw = np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    frames.append(packer.compress(raw))
                    keys.append(k)
                    counts.append(len(raw) // 4)
                    before += counts[-1]
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                        yield full()
                        block, keys, counts, frames, size = block + 1, [], [], [], 0
        if keys:
            yield full()

    rows.mapInArrow(run, BLOCKS).write.option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/blocks")
    return dictionary


def read_dictionary(spark, path: str) -> tuple[str, bytes]:
    row = spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    held = bytes(row.dictionary)
    if hashlib.sha256(held).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary in {path} doesn't have its own hash")
    return row.sha256, held


def _unpack(batches: Iterator[pa.RecordBatch], digest: str, dictionary: bytes, wanted: frozenset | None = None) -> Iterator[tuple[dict, list[tuple[int, int | None, np.ndarray]]]]:
    """Of each block, its row and the (place, key, ids) of its documents."""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["dictionary"] != digest:
                raise ValueError("a block was compressed with another dictionary")
            at, payload = row["offsets"], row["payload"]
            yield row, [(i, key, np.frombuffer(unpacker.decompress(payload[at[i] : at[i + 1]]), "<u4")) for i, key in enumerate(row["doc_ids"]) if wanted is None or key in wanted]


def read_tokens(spark, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: blocks whose id range holds none are passed over, and only the documents' frames are opened."""
    digest, dictionary = read_dictionary(spark, path)
    wanted = frozenset(keys)
    near = F.exists(F.array(*(F.lit(k).cast("long") for k in sorted(wanted))), lambda k: k.between(F.col("first_id"), F.col("last_id")))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("last_id") >= min(wanted)) & (F.col("first_id") <= max(wanted)) & near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs in _unpack(batches, digest, dictionary, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([d[1] for d in docs], pa.int64()), pa.array([d[2].astype(np.int64) for d in docs], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<bigint>")


def read_index(spark, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the decompressed ids of the file."""
    digest, dictionary = read_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # A row for each partition written: their count bounds the broadcast.
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, docs in _unpack(batches, digest, dictionary):
            counts = np.array([len(ids) for _, _, ids in docs], np.int64)
            if counts.tolist() != row["n_tokens"]:
                raise ValueError("a frame doesn't hold its count of ids")
            starts = row["base"] + row["start_in_part"] + np.cumsum(counts) - counts
            crcs = [zlib.crc32(ids.tobytes()) for _, _, ids in docs]
            yield pa.RecordBatch.from_arrays([pa.array([d[1] for d in docs], pa.int64()), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    schema = f"{textio.quoted(key)} long, start long, n_tokens long, ids_crc32 long"
    return blocks.join(F.broadcast(bases), "part").mapInArrow(run, schema)


def encode_to_file(docs: DataFrame, *, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to a token-id file in the shared folder and give back what its index and frames hold."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{textio.shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer=tokenizer, key=key, text=text)
    return read_index(docs.sparkSession, path, key)


def op9_zstd_token_file(spark, sf_dir: str) -> DataFrame:
    return encode_to_file(spark.read.parquet(f"{sf_dir}/documents.parquet"))

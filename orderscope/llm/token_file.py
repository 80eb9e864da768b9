"""Token ids in files of shuffled byte or bit planes (operator 5).

A file holds the ids of a run of documents as fixed-size blocks. Each block is transposed:
all first bytes (or bits) of its ids, then all second ones, and so on; each plane is
compressed with zstandard on its own, all-zero planes are left out. After the blocks
come the document index, the chunk index, and their places:

    "PLN1" | block ... | documents (Arrow stream, zstd) | chunk index (Arrow stream) | footer

The chunk index has, for each block, its first id's position, its number of ids, its
offset in the file and the sizes of its planes, so any id range is read with one seek.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderscope.llm.common import save, shuffle_partitions, table
from orderscope.llm.token_counts import vocabulary
from orderscope.llm.token_units import PLAIN, byte_letters, split_units, text_slices
from orderscope.session import scratch_path

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 16
CACHE_PIECES = 600_000  # pre-tokens whose ids a worker holds
FOOTER = struct.Struct("<QQQQ4s")  # documents: offset, size; chunk index: offset, size; magic
CHUNKS = pa.schema([("first", pa.int64()), ("ids", pa.int32()), ("offset", pa.int64()), ("planes", pa.list_(pa.int32()))])
END_ID = 0
# The library's byte-level pre-token pattern (it is not written in the vocabulary file).
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# -- planes -------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; empty where all zero."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = raw.T
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of 4 byte planes or 32 bit planes."""
    rows = n if len(planes) == 4 else (n + 7) // 8
    held = np.zeros((len(planes), rows), np.uint8)
    for i, p in enumerate(planes):
        if p:
            held[i] = np.frombuffer(p, np.uint8)
    if len(planes) != 4:
        held = np.packbits(np.unpackbits(held, axis=1)[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(held.T).view("<u4").ravel()


class Writer:
    """Writes one file; holds at most a block of ids, and one index row for each document."""

    def __init__(self, out, doc_type: pa.DataType, bits: bool = False, level: int = 1):
        self.out, self.bits, self.doc_type = out, bits, doc_type
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.waiting = self.at = self.written = 0
        self.chunks: list[tuple] = []
        self.docs: list[pa.RecordBatch] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.chunks.append((self.written, len(ids), self.at, [len(p) for p in planes]))
        self._put(b"".join(planes))
        self.written += len(ids)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the numbers of their ids, and all those ids."""
        self.docs.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(lengths, pa.int64())], names=["doc_id", "n"]))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            cut = len(ids) - len(ids) % BLOCK_IDS
            for i in range(0, cut, BLOCK_IDS):
                self._block(ids[i : i + BLOCK_IDS])
            self.held, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> int:
        if self.waiting:
            self._block(np.concatenate(self.held))
        docs, chunks = io.BytesIO(), io.BytesIO()
        schema = pa.schema([("doc_id", self.doc_type), ("n", pa.int64())])
        with pa.ipc.new_stream(docs, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in self.docs:
                w.write_batch(b)
        with pa.ipc.new_stream(chunks, CHUNKS) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.chunks, strict=True), CHUNKS, strict=True)] if self.chunks else [pa.array([], t.type) for t in CHUNKS], schema=CHUNKS))
        a, b = self.at, self.at + len(docs.getvalue())
        self._put(docs.getvalue())
        self._put(chunks.getvalue())
        self._put(FOOTER.pack(a, b - a, b, len(chunks.getvalue()), MAGIC))
        return self.written


class Reader:
    """Reads a file of the format; blocks come one at a time."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        a, n, b, m, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token id planes")
        self.doc_place, self.zstd = (a, n), zstandard.ZstdDecompressor()
        source.seek(b)
        self.chunks = pa.ipc.open_stream(source.read(m)).read_all().to_pylist()

    def documents(self):
        """Batches (doc_id, n) in file order."""
        self.source.seek(self.doc_place[0])
        yield from pa.ipc.open_stream(self.source.read(self.doc_place[1]))

    def block(self, i: int) -> np.ndarray:
        c = self.chunks[i]
        self.source.seek(c["offset"])
        raw = self.source.read(sum(c["planes"]))
        planes, at = [], 0
        for n in c["planes"]:
            planes.append(self.zstd.decompress(raw[at : at + n]) if n else b"")
            at += n
        return from_planes(planes, c["ids"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file, from the blocks that hold them."""
        parts = [
            self.block(i)[max(0, start - c["first"]) : stop - c["first"]]
            for i, c in enumerate(self.chunks)
            if c["first"] < stop and start < c["first"] + c["ids"]
        ]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


# -- encoding -----------------------------------------------------------------------------


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Pieces:
    """The ids of pre-tokens, in one array; each is merged once, until too many are held."""

    def __init__(self, merge):
        self.merge = merge
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size, self.start = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.spaced = np.empty(0, bool)  # whether a piece begins with a space

    def __call__(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces, valid until the next call."""
        if len(self.index) > CACHE_PIECES:
            self.clear()
        index = self.index
        new = list(set(pieces).difference(index))
        if new:
            found = self.merge(new)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
            self.start = np.cumsum(self.size) - self.size
            self.spaced = np.concatenate([self.spaced, np.array([p[0] == " " for p in new])])
        return np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))


class Encoder:
    """Ids of whole texts, as the library gives them for a byte-level BPE, with an end id.

    The pre-token pattern lets a space go with the word after it, so a text may be cut
    before each single space that has a character other than white space on either side.
    Texts that cannot be cut so everywhere go to the library whole. Of a slice of texts the
    distinct units are cut into pre-tokens together, as one text, and only pre-tokens never
    seen are merged.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = Pieces(self._merge)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        # no piece holds U+0000: PLAIN has none
        return [[t.id for t in tokenize(p)] for p in byte_letters("\0".join(pieces)).split(byte_letters("\0"))]

    def _units(self, units: list[str], solid: np.ndarray, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the units, each after a space, and then of the heads as they are.
        ``solid`` units begin and end with other than white space."""
        joined = " " + " ".join(units if solid.all() else list(compress(units, solid)))
        if not PLAIN.fullmatch(joined) or "<|" in joined:
            solid = np.array([s and PLAIN.fullmatch(u) is not None and "<|" not in u for u, s in zip(units, solid, strict=True)], bool)
            joined = " " + " ".join(compress(units, solid))
        pieces = PRETOKEN.findall(joined) if solid.any() else []
        others = [(i, " " + units[i]) for i in np.flatnonzero(~solid).tolist()] + [(len(units) + i, u) for i, u in enumerate(heads)]
        odd = {i: u for i, u in others if not PLAIN.fullmatch(u) or "<|" in u}
        cut = {i: PRETOKEN.findall(u) for i, u in others if i not in odd}
        number = self.pieces(pieces + [p for ps in cut.values() for p in ps])
        # where each unit's pieces are; of a solid unit only the first one begins with a space
        counts, where = np.zeros((2, len(units) + len(heads)), np.int64)
        begins = np.flatnonzero(self.pieces.spaced[number[: len(pieces)]])
        where[: len(units)][solid] = begins
        counts[: len(units)][solid] = np.diff(np.r_[begins, len(pieces)])
        at = len(pieces)
        for i, ps in cut.items():
            where[i], counts[i] = at, len(ps)
            at += len(ps)
        number = number[_spread(where, counts)]
        owner = np.repeat(np.arange(len(counts)), counts)
        piece_size = self.pieces.size[number]
        size = np.bincount(owner, piece_size, len(counts)).astype(np.int64)
        ids = self.pieces.ids[_spread(self.pieces.start[number], piece_size)]
        if odd:
            found = self._whole(list(odd.values()))
            extra = np.fromiter(map(len, found), np.int64, len(found))
            begin = np.cumsum(size) - size
            begin[list(odd)] = len(ids) + np.cumsum(extra) - extra
            size[list(odd)] = extra
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32)])[_spread(begin, size)]
        return size, ids

    def __call__(self, texts: pa.Array):
        """(first, lengths, ids) for slices of the texts; each text ends with END_ID."""
        for first, part in text_slices(texts):
            offsets, codes, units = split_units(part)
            ends = "".join([u[0] + u[-1] if u else "  " for u in units])
            letter = np.frombuffer(ends.encode("utf-32-le", "surrogatepass"), np.uint32)
            plain = (letter > 0x20) & (letter < 0x7F)
            rare = np.flatnonzero(~plain)
            plain[rare] = [not ends[i].isspace() for i in rare]
            opens, closes = plain[::2], plain[1::2]
            empty = np.zeros(len(units), bool)
            empty[[i for i, u in enumerate(units) if not u]] = True
            head = offsets[:-1]
            is_head = np.zeros(len(codes) + 1, bool)
            is_head[head] = True
            # the cut between part i and i + 1 of one text; before an empty first part it is at the start
            sound = closes[codes[:-1]] | opens[codes[1:]] | is_head[1:-1] | (is_head[:-2] & empty[codes[:-1]])
            broken = np.add.reduceat(np.r_[~sound, False].astype(np.int64), head) > 0
            size, ids = self._units(units, opens & closes, [units[c] for c in codes[head]])
            item = codes.astype(np.int64).copy()
            item[head] = len(units) + np.arange(len(head))
            whole = np.flatnonzero(broken)
            found = self._whole([part[int(i)].as_py() for i in whole])
            size = np.r_[size, [len(f) for f in found], 1].astype(np.int64)
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.uint32), np.array([END_ID], np.uint32)])
            # the items of each text in order, with the end id after its last one
            keep = ~np.repeat(broken, np.diff(offsets))
            keep[head[whole]] = True
            item[head[whole]] = len(units) + len(head) + np.arange(len(whole))
            text_of = np.repeat(np.arange(len(part)), np.diff(offsets))
            places = np.arange(len(item)) + text_of
            items = np.full(len(item) + len(part), len(size) - 1)
            kept = np.ones(len(items), bool)
            items[places], kept[places] = item, keep
            owner = np.empty(len(items), np.int64)
            owner[places] = text_of
            owner[offsets[1:] + np.arange(len(part))] = np.arange(len(part))
            items, owner = items[kept], owner[kept]
            start, each = (np.cumsum(size) - size)[items], size[items]
            yield first, np.bincount(owner, each, len(part)).astype(np.int64), ids[_spread(start, each)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process: a reused worker keeps its vocabulary and its cache."""
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, bits: bool = False) -> DataFrame:
    """Encode ``docs`` and write its ids in ascending doc_id order to files under ``path``.

    Returns the manifest, one row for each file in order: part, file, documents, ids, start
    (the ids of all files before it). ``path`` must be reachable from every executor. A
    task writes a file of its own name and the manifest lists only files of tasks that
    ended well, so a lost executor leaves at most unlisted files. Texts move once.

    Defined cases: null and empty texts have the end id only; null ids come first; equal ids
    are ordered by text hash; an empty table gives an empty manifest.
    """
    vocab = tokenizer or vocabulary("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_rk"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_rk").sortWithinPartitions("doc_id", "_rk")

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.pln"
        encode = writer = out = None
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                encode, out = encoder(vocab), fs.open_output_stream(f"{root}/{name}")
                writer = Writer(out, batch.schema.field("doc_id").type, bits)
            for first, lengths, ids in encode(batch.column("text")):
                writer.add(batch.column("doc_id").slice(first, len(lengths)), lengths, ids)
            count += batch.num_rows
        if writer is not None:
            total = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "documents": [count], "ids": [total]},
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]),
            )

    done = save(rows.mapInArrow(run, "part int, file string, documents long, ids long"), "manifest").orderBy("part").collect()
    start, listed = 0, []
    for r in done:  # one row for each file
        listed.append((r["part"], r["file"], r["documents"], r["ids"], start))
        start += r["ids"]
    return spark.createDataFrame(listed, "part int, file string, documents long, ids long, start long")


def read_token_files(spark: SparkSession, manifest: DataFrame, path: str, doc_type: str = "long") -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    The crc is of the ids as little-endian unsigned 32-bit integers. A task holds the blocks
    of one document and the one after them.

    Defined cases: a document without ids but its end has n_tokens 1; repeated ids are rows of
    their own; an empty manifest gives no rows; a file that is not of the format raises.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    reader = Reader(source)
                    chunk, held, at = 0, np.empty(0, np.uint32), 0
                    for docs in reader.documents():
                        lengths = docs.column("n").to_numpy()
                        starts, crcs = [], []
                        for n in lengths.tolist():
                            parts, missing = [held[:n]], n - len(held[:n])
                            held = held[n:]
                            while missing > 0:
                                block = reader.block(chunk)
                                chunk += 1
                                parts.append(block[:missing])
                                held, missing = block[missing:], missing - len(block[:missing])
                            starts.append(row["start"] + at)
                            crcs.append(zlib.crc32(b"".join(p.astype("<u4").tobytes() for p in parts)))
                            at += n
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pa.array(starts, pa.int64()), docs.column("n"), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    files = manifest.repartition(max(1, shuffle_partitions(spark)), "file")
    return files.mapInArrow(run, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def op5_bit_planes(spark, sf_dir):
    """Query: encode all documents, write the files, read them back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "llm-token-files")
    manifest = write_token_files(docs, path)
    return read_token_files(spark, manifest, path, docs.schema["doc_id"].dataType.simpleString())

"""Token ids in flat binary files with 64-bit document offsets.

Format. A data set is a folder of parts in ascending doc_id order. Part k has

* ``part-KKKKK.ids``: token ids of its documents, one after the other, as
  little-endian unsigned integers: 16 bits where the vocabulary has at most
  65,536 ids, else 32;
* ``part-KKKKK.off``: little-endian unsigned 64-bit integers, one more than it
  has documents: the id index, within the part, at which each document starts,
  and the number of ids;
* ``part-KKKKK.doc``: the doc_ids, signed 64-bit, those without one first, as 0;
  then how many have none.

A part's place in the whole, its *base*, is the sum of the ids of the parts
before it: a prefix sum over one count for each part, the only thing that is
gathered. Local files are memory-mapped by readers.

Documents are dealt by range of doc_id, a hash of the text and a row number, so
a part is a contiguous range and rows of one id or none need not share a part; a
task that runs again writes the same bytes under the same name, through a
temporary name, so lost executors and repeated tasks leave one whole file.
Files go through ``pyarrow.fs``: any store that it opens by URI will do.

Encoding. The ids are those of the tokenizers library for the given file
(no special tokens added; their strings in a text count as special, as in the
library). Texts are cut before blanks that follow and precede other than white
space, where the pre-tokenizer always cuts; pieces met lately come from a
worker's memory, others go through tiktoken, built from the ranks in the same
file, which gives the same ids several times faster; texts that hold a special
string go through the tokenizers library itself.

Defined cases: null counts as empty; an empty text has the end id alone; rows
with equal or null doc_id keep their own entries (nulls first), in order of a hash
of the text.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._units import UnitMemo, encode_spans
from lodestone.session import scratch_path

#: Bytes of text in a part, about.
PART_BYTES = 64 << 20
MEMO_PIECES = 400_000

MANIFEST = "part int, docs long, tokens long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ByteBpe:
    """Byte-level BPE of a tokenizers file, with a memory of recent pieces."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        with open(path) as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        import public_tokenizers

        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        self.memo = UnitMemo(self._encode, MEMO_PIECES)

    def _encode(self, found: list[bytes]) -> list[bytes]:
        encode = self.fast.encode_ordinary
        return [np.array(encode(u.decode()), self.dtype).tobytes() for u in found]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's ids start (one entry more)."""
        buf, offsets = T.flat(texts)
        start, end, first = self.spans(buf, offsets)
        ids, edges = encode_spans(buf, start, end, first, self.memo, self.dtype)
        if self.special is None or not self.special.search(buf.tobytes()):
            return ids, edges
        parts = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        for i in range(len(parts)):
            data = buf[offsets[i] : offsets[i + 1]].tobytes()
            if self.special.search(data):
                parts[i] = np.array(self.whole.encode(data.decode(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    @staticmethod
    def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that the pre-tokenizer never crosses: cut before a blank between
        characters that are surely no white space. Where a neighbour may be white
        space outside ASCII, there is no cut; the span is then longer, not wrong."""
        cut = buf == 32
        before, after = _MAYBE_SPACE_END[buf], _MAYBE_SPACE_START[buf]
        cut[1:] &= ~before[:-1]
        cut[:-1] &= ~after[1:]
        wide = buf >= 0xE1
        wide &= buf <= 0xE3
        cut[3:] &= ~wide[:-3]
        cut[2:] &= ~((buf[:-2] == 0xC2) & ((buf[1:-1] == 0x85) | (buf[1:-1] == 0xA0)))
        filled = np.diff(offsets) > 0
        cut[offsets[1:][filled] - 1] = False
        cut[offsets[:-1][filled]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(buf)), np.searchsorted(start, offsets)


_MAYBE_SPACE_END = np.zeros(256, bool)
_MAYBE_SPACE_END[[*range(9, 14), *range(28, 33)]] = True
_MAYBE_SPACE_START = _MAYBE_SPACE_END.copy()
_MAYBE_SPACE_START[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level BPE files: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _name(part: int, kind: str) -> str:
    return f"part-{part:05d}.{kind}"


class _PartWriter:
    """Files of one part, visible under their names only when whole."""

    def __init__(self, uri: str, part: int, dtype: np.dtype):
        self.fs, self.root = _fs(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.dtype = part, dtype
        self.mark = f".{uuid.uuid4().hex}"
        self.out = {k: self.fs.open_output_stream(self._path(k) + self.mark) for k in ("ids", "off", "doc")}
        self.tokens, self.docs, self.nulls = 0, 0, 0

    def _path(self, kind: str) -> str:
        return posixpath.join(self.root, _name(self.part, kind))

    def add(self, ids: np.ndarray, edges: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> None:
        self.out["ids"].write(ids.tobytes())
        self.out["off"].write((self.tokens + edges[:-1]).astype("<u8").tobytes())
        self.out["doc"].write(doc_ids.astype("<i8").tobytes())
        self.tokens += len(ids)
        self.docs += len(doc_ids)
        self.nulls += int((~known).sum())

    def close(self) -> None:
        self.out["off"].write(np.array([self.tokens], "<u8").tobytes())
        self.out["doc"].write(np.array([self.nulls], "<i8").tobytes())
        for kind, stream in self.out.items():
            stream.close()
            self.fs.move(self._path(kind) + self.mark, self._path(kind))


def write(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the token files of ``docs`` below ``uri``; return part, docs, tokens and base of each part."""
    spark = docs.sparkSession
    C.tune(spark)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(C.partitions(spark), -(-size // part_bytes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer_path)
        out = _PartWriter(uri, TaskContext.get().partitionId(), bpe.dtype)
        for table in C.bounded(batches):
            ids, known = C.doc_ids(table)
            tokens, edges = bpe.encode(table.column("text"))
            tokens = np.insert(tokens, edges[1:], end_id)
            out.add(tokens, edges + np.arange(len(edges)), ids, known)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([out.part], pa.int32()), pa.array([out.docs], pa.int64()), pa.array([out.tokens], pa.int64())], names=["part", "docs", "tokens"]
        )

    order = ("doc_id", "__hash", "__row")
    cols = cols.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    dealt = cols.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = scratch_path(spark, "token-manifest")
    dealt.mapInArrow(work, MANIFEST).write.parquet(manifest)
    # One row for each part: a few bytes for 64 MB of text.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(manifest).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class PartReader:
    """One part's arrays; memory-mapped where its files are local."""

    def __init__(self, uri: str, part: int, dtype: np.dtype):
        fs, root = _fs(uri)
        self.ids = self._array(fs, posixpath.join(root, _name(part, "ids")), dtype)
        self.offsets = self._array(fs, posixpath.join(root, _name(part, "off")), "<u8")
        listed = self._array(fs, posixpath.join(root, _name(part, "doc")), "<i8")
        self.doc_ids, self.nulls = listed[:-1], int(listed[-1])

    @staticmethod
    def _array(fs, path: str, dtype) -> np.ndarray:
        if fs.type_name == "local":
            return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.zeros(0, dtype)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[int(self.offsets[k]) : int(self.offsets[k + 1])]


def read(spark: SparkSession, manifest: DataFrame, uri: str, dtype: np.dtype, batch: int = 4096) -> DataFrame:
    """Read the files back: place, length and checksum of each document's ids."""
    n = max(1, C.partitions(spark))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                part = PartReader(uri, row["part"], dtype)
                starts = part.offsets.astype(np.int64)
                for a in range(0, len(part), batch):
                    b = min(len(part), a + batch)
                    sums = [zlib.crc32(part[k].astype("<u4").tobytes()) for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.doc_ids[a:b], mask=np.arange(a, b) < part.nulls), pa.array(row["base"] + starts[a:b]), pa.array(np.diff(starts[a : b + 1])), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.where("docs > 0").repartition(n, "part").mapInArrow(work, ENTRIES)


def vocabulary_dtype(tokenizer_path: str) -> np.dtype:
    """Width of the ids in the files of a tokenizer."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")


def round_trip(docs: DataFrame, tokenizer_path: str, uri: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` and read the files back."""
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "tokens")
    return read(spark, write(docs, uri, tokenizer_path, end_id), uri, vocabulary_dtype(tokenizer_path))

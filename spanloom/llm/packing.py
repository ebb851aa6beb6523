"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups.

Each document is cut at every multiple of the sequence length; whole pieces are sequences already, and the
rest of each document goes by a hash into a group of bounded expected size. Within a group the rests are
placed longest first into the first bin with room, found in logarithmic time by a tournament tree of what
the bins have left. Only piece rows (no tokens) are ever shuffled.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, kept, lean, materialise, slices, small_batches
from .words import WordTable, plain_rows, split

class ByteEncoder:
    """ids of ``tokenizers`` for a byte-level BPE file, for whole Arrow columns.

    Words are split by array operations and encoded once each (``WordTable``). Texts beyond Latin-1 letters,
    and texts with special tokens in them, go to the library itself as a whole.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.table = WordTable(self.words)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.merge(w.decode()) for w in words]
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each row."""
        data, offsets = flat(texts)
        plain = plain_rows(data, offsets)
        if any(s in data.tobytes() for s in self.special):
            plain &= ~np.array([any(s in data[a:b].tobytes() for s in self.special) for a, b in zip(offsets[:-1], offsets[1:])], bool)
        starts, ends = split(data, offsets, keep_space=True)
        if not plain.all():
            ok = plain[np.searchsorted(offsets, starts, side="right") - 1]
            starts, ends = starts[ok], ends[ok]
        ids, size = self.table.lookup(data, starts, ends)
        at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        for i in np.flatnonzero(~plain):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


@kept
def byte_encoder(tokenizer: str, ranks: str) -> ByteEncoder:
    """One for each Python worker: the table of words serves its later tasks of packing too."""
    return ByteEncoder(tokenizer, ranks)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Longest first, ties by position; each into the first bin with room for it."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    left = [room] * (2 * width)  # a node holds the most that any bin under it has left
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if left[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, room - left[at]
        left[at] -= size
        at //= 2
        while at:
            most = max(left[2 * at], left[2 * at + 1])
            if left[at] == most:
                break
            left[at] = most
            at //= 2
    return bins, offsets


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, serial bigint"


def _cut(encoder_args: tuple[str, str], room: int, end_id: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, serial = byte_encoder(*encoder_args), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for i, ids in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text"))):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for a in range(0, len(ids), room):
                        x = ids[a : a + room]
                        rows.append((i, a, len(x), zlib.crc32(x), len(ids), part, serial))
                        serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def _place(room: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("part", "ascending"), ("serial", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), room)
        group = table.column("grp").to_numpy()
        return table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(group << 32 | bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", room: int = 1024, end_id: int = 0, group: int = 8192, seed: int = 11) -> DataFrame:
    """Packs all rows into sequences of at most ``room`` tokens; a row per piece.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Null and empty texts are one
    piece with the end id alone. Repeated rows are packed as often as they occur. Items of one length
    keep the order of (id, start). Null ids stay null. An empty table gives an empty result. Other columns
    are ignored. The longer a text, the more pieces; no piece is dropped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(docs.mapInArrow(_cut((tokenizer, ranks), room, end_id), PIECES), "pieces")
    rest = pieces.where(F.col("length") < room)
    groups = max(1, -(-rest.count() // group))
    # items of a group share a hash value, not a key of the data: no group can be hot
    rest = rest.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "part", "serial"), F.lit(groups)))
    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = rest.groupBy("grp").applyInArrow(_place(room), out)
    whole = pieces.where(F.col("length") == room).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.col("part") * (1 << 36) + F.col("serial")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole)

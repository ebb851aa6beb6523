"""Shared pieces of the corpus operators: Arrow text buffers, vectorised hashing, durable tables.

Every kernel here works on whole Arrow batches as flat byte arrays, so the cost of Python per document
is small and memory is bounded by the batch (``slices``), never by the table.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES, SLICE_ROWS = 1 << 20, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder is made and put into the session; on a
    cluster an unset folder is an error, as no folder of one machine is seen by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._spanloom_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Deletes the files of tables of ``materialise`` that nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._spanloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of a bounded number of rows and bytes, so that Python workers stay small.

    The plans are lazy, so the settings stay in the session; what the user has set is left alone. Results don't
    depend on them (``slices`` bounds what a kernel sees), only memory does.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


#: How to drop what each module's ``kept`` functions hold.
KEPT: dict[str, list[Callable[[], None]]] = {}


def kept(make: Callable) -> Callable:
    """``functools.cache`` for what a Python worker keeps from task to task: it goes when a ``lean`` kernel of another module runs there."""
    made = cache(make)
    KEPT.setdefault(make.__module__, []).append(made.cache_clear)
    return made


@cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Returns freed memory to the system, which allocators keep otherwise as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def drop_kept(but: str) -> None:
    """Drops what other modules than ``but`` keep in this worker."""
    for module, clears in KEPT.items():
        if module != but:
            for clear in clears:
                clear()


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel of ``mapInArrow`` whose worker holds no other operator's tables during a task, and no freed memory after it.

    Workers outlive stages: without this an executor holds the largest stage so far beside the one that runs.
    """
    module = kernel.__module__

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(module)
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, mod: int):
    """crc32(id as text) mod ``mod``: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)), offsets - first


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by bytes of one column and by rows; a row that is longer than ``most`` alone comes alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, x in enumerate(size):
        if i > at and (total + x > most or i - at == rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(x)
    if batch.num_rows > at:
        yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: The first n bytes of a little-endian word of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG = 64


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many byte ranges of one buffer, eight bytes of all ranges at a time; long ranges by xxHash."""
    n = ends - starts
    if not len(n):
        return np.empty(0, U64)
    at = _eights(data)
    h = mix(mix(n.astype(U64) + U64(0x9E3779B97F4A7C15)) ^ (at[starts] & MASKS[np.minimum(n, 8)]))
    live, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        left = n[live] - k
        h[live] = mix(h[live] * U64(0x9FB21C651E98DF25) ^ (at[starts[live] + k] & MASKS[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def ranges_equal(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the k-th range of ``a`` has the bytes of the k-th range of ``b``."""
    n = a_ends - a_starts
    same = n == b_ends - b_starts
    x, y = _eights(a), _eights(b)
    live, k = np.flatnonzero(same & (n > 0) & (n <= LONG)), 0
    while len(live):
        left = n[live] - k
        ok = ((x[a_starts[live] + k] ^ y[b_starts[live] + k]) & MASKS[np.minimum(left, 8)]) == 0
        same[live[~ok]] = False
        live, k = live[ok & (left > 8)], k + 8
    for i in np.flatnonzero(same & (n > LONG)).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_ends[i]], b[b_starts[i] : b_ends[i]])
    return same


def runs(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of word bytes, never across rows."""
    n = len(is_word)
    if not n:
        return (np.empty(0, np.int64),) * 3
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    inner = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[inner] |= is_word[inner]
    end = np.zeros(n + 1, bool)
    end[1:n] = is_word[:-1] & (~is_word[1:] | start[1:])
    end[n] = is_word[-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def with_least(edges: DataFrame, salts: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least of u and all its v.

    A u with very many v is dealt over ``salts`` tasks, both where its v are counted and where m comes back to them.
    """
    edges = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    part = edges.groupBy("u", "s").agg(F.min("v").alias("m"))
    part = part.withColumn("m", F.least("u", F.min("m").over(Window.partitionBy("u"))))  # at most ``salts`` rows of a u
    return edges.join(part, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, name: str = "cc", src: str = "src", dst: str = "dst", salts: int = 128) -> DataFrame:
    """Connected components of an edge table: ``(id, component_id)`` with the smallest id of each component.

    Alternates large-star and small-star contraction (public: Kiveris et al., "Connected Components in
    MapReduce and Beyond"): the number of edges never grows, rounds are logarithmic in practice, and no key
    meets more than a ``salts``-th of a component's edges in one task. Each round is a table in the shared folder. Nodes
    without edges don't appear. Self-loops and null ends are ignored; empty input gives an empty table.
    """
    a, b = F.col(src), F.col(dst)
    cur = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur, before = materialise(cur, name), None
    while True:
        # large-star: every larger neighbour of u gets the least of u's neighbourhood
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: the smaller neighbours of u, and u, get the least of them
        small = with_least(large, salts).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        new = materialise(small, name)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_tables(cur)
        cur = new
        if now == before or not now[0]:  # the same set of edges again: every node points at its root
            break
        before = now
    out = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return out.unionByName(roots)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front until no column of ``df`` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_columns(df: DataFrame, more: str) -> str:
    """The schema of ``df`` as DDL with more columns."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 1 << 20) -> DataFrame:
    """``(id, text, y)`` of at most ``per_class[y]`` ids of each label y, those with the least id hashes; the same at every run.

    An id labelled both ways counts as the greater label; of an id with several texts the first in order is taken. Null
    texts and texts of more than ``row_bytes`` bytes are no examples.
    """
    marked = labels.where(may_learn & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    classes = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in sorted(per_class.items())]
    picked = classes[0]
    for more in classes[1:]:
        picked = picked.unionByName(more)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= row_bytes)
    # the limits bound what is broadcast
    return texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def learn_in_a_task(sample: DataFrame, fit: Callable[[list[tuple]], dict], order: list, most_bytes: int, text_col: str = "text") -> dict:
    """``fit`` of the rows of a bounded sample, run in one task: neither texts nor training are the driver's.

    Rows come as tuples, in the given order, as long as their texts have ``most_bytes`` bytes together at most.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], most_bytes
        for batch in batches:
            for row, n in zip(zip(*(c.to_pylist() for c in batch.columns)), pc.binary_length(batch.column(text_col)).to_pylist()):
                left -= n
                if left < 0:
                    break
                rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    small_batches(sample.sparkSession)
    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else fit([])

"""Exact n-gram Jaccard self-join with multiple-global-order prefix filtering.

A document is the set of its distinct word 5-grams. Two sets x, y with J(x, y) >= t share at least
one token among the first ``|x| - ceil(t |x|) + 1`` tokens of each under *any* total order of the tokens.
So candidates must share a prefix token under every one of several orders, and the filters are
intersected (with the size filter) before anything is verified.

* All orders put rare tokens first; tokens found in one document only can't be shared, so they fill a
  prefix but are never indexed. In prose they fill nearly every prefix: what is left is the documents
  that consist of shared text by four fifths.
* One pass over the texts makes, for each block of documents, one sorted blob of distinct token hashes for
  each hash bucket; a bucket's task counts the documents of each token and sends back the shared ones only.
  A token of several documents of a block goes to its bucket once, with their number, and the list of them
  goes straight to the block: a token that a third of all documents hold is one entry a block.
* Equal sets are one class; all other work is on class representatives.
* Candidates: first every list of a prefix token is linked to two leaders only (linear), and what these
  links join is contracted. Lists that still hold several components meet under their leader, in chunks
  of bounded size: chunks are verified against chunks by matrix products inside a task, chunks of one
  component not at all, and only links of a spanning forest come out. So no group is expanded into pairs.
* No key gathers a third of all rows in one task: equal sets meet within a block, then within a 256th of all
  blocks, then 256 rows at most; lists and leaders are dealt over as many tasks as their counts ask for, which both
  sides of a join know beforehand.

Tokens are 64-bit hashes of the word sequences; J is exact on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, components, drop_tables, flat, lean, materialise, mix, ranges_hash, runs, slices, small_batches

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
STEPS = mix(np.arange(1, 65, dtype=U64)) | U64(1)
ORDERS = 3
CHUNK, CHUNK_TOKENS = 128, 400_000
#: Rows of a key in one task where the key's rows are counted beforehand.
SHARE = 2048
#: Parts in which equal sets of different blocks meet first.
PARTS = 256
#: In place of a document's position in its block: several documents of the block hold the token.
SEVERAL = 0xFFFF


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``width`` are one shingle, none none."""
    low = LOWER[data]
    starts, ends, row = runs(IS_WORD[low], offsets)
    h = ranges_hash(low, starts, ends)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    full = mix(sum(h[k : len(h) - width + 1 + k] * STEPS[k] for k in range(width))) if len(h) >= width else np.empty(0, U64)
    out = []
    for i in range(rows):
        a, n = first[i], count[i]
        if n >= width:
            out.append(np.unique(full[a : a + n - width + 1]))
        elif n:
            out.append(mix((h[a : a + n] * STEPS[:n]).sum(dtype=U64, keepdims=True) + STEPS[n : n + 1]))
        else:
            out.append(np.empty(0, U64))
    return out


def _scan(id_col: str, text_col: str, width: int, bits: int):
    """Rows (bucket, block, idx, hi, lo, many): what a block of documents sends to each bucket.

    ``idx`` holds documents by position; ``many`` the numbers of documents of the tokens whose ``idx`` is SEVERAL.
    Bucket -1-x holds the block's documents (``idx``) and of such tokens the hashes (``hi``), documents (``lo``) and
    numbers of documents (``many``).
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, text_col, 4 << 20, SEVERAL):
                sets = shingle_sets(*flat(piece.column(text_col)), width)
                ids = pc.fill_null(piece.column(id_col), 0).to_numpy(zero_copy_only=False)  # filled here: NumPy would make nulls floats
                null = piece.column(id_col).is_null().to_numpy(zero_copy_only=False)
                block = part << 32 | serial
                serial += 1
                size = np.array([len(s) for s in sets], np.int64)
                sig = np.array([(mix(s).sum(dtype=U64), mix(s ^ STEPS[50]).sum(dtype=U64)) for s in sets], U64).reshape(-1, 2)
                # equal sets of the block send their tokens once, under the smallest id
                order = np.lexsort((ids, null, sig[:, 1], sig[:, 0]))  # a null id leads no set that has others
                s = sig[order]
                lead = np.ones(len(order), bool)
                lead[1:] = (s[1:] != s[:-1]).any(1)
                sender = np.zeros(len(order), bool)
                sender[order[lead]] = True
                rep = np.empty(len(order), np.int64)
                rep[order] = ids[order[lead]][np.cumsum(lead) - 1]
                sender &= ~null & (size > 0)
                meta = np.rec.fromarrays([ids, size, sig[:, 0].view(np.int64), sig[:, 1].view(np.int64), rep, null], names="id,n,a,b,rep,null")
                who = np.flatnonzero(sender)
                rows, local = [], (b"", b"", b"")
                if len(who):
                    tok = np.concatenate([sets[i] for i in who])
                    idx = np.repeat(who.astype(np.uint16), size[who])
                    by = np.argsort(tok)
                    tok, idx = tok[by], idx[by]
                    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
                    held = np.diff(edge)
                    among = np.repeat(held > 1, held)
                    tok, several = tok[edge[:-1]], held > 1
                    local = (tok[several].tobytes(), idx[among].tobytes(), held[several].astype(np.uint16).tobytes())
                    idx = np.where(several, np.uint16(SEVERAL), idx[edge[:-1]])
                    cut = np.searchsorted(tok >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
                    rest = tok & U64((1 << 64 - bits) - 1)
                    for b in np.flatnonzero(np.diff(cut)):
                        x = rest[cut[b] : cut[b + 1]]
                        gap = np.diff((x >> U64(32)).astype(np.int64), prepend=0)
                        span = slice(cut[b], cut[b + 1])
                        many = held[span][several[span]].astype(np.uint16).tobytes()
                        rows.append((int(b), block, idx[span].tobytes(), packed_gaps(gap), (x & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), many))
                rows.append((-1 - block % (1 << bits), block, meta.astype(META).tobytes(), *local))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "block", "idx", "hi", "lo", "many"])

    return run


def packed_gaps(gap: np.ndarray) -> bytes:
    """Non-negative integers below 2**48 as bytes: one or two each, and eight more for each that needs more than two."""
    if gap.max() < 256:
        return gap.astype(np.uint8).tobytes()
    over = np.flatnonzero(gap >> 16)
    return (gap & 0xFFFF).astype(np.uint16).tobytes() + np.stack([over, gap[over] >> 16], 1).astype(np.uint32).tobytes()


def unpacked_gaps(raw, n: int) -> np.ndarray:
    if len(raw) == n:
        return np.frombuffer(raw, np.uint8).astype(U64)
    gap = np.frombuffer(raw, np.uint16, n).astype(U64)
    over = np.frombuffer(raw, np.uint32, offset=2 * n).reshape(-1, 2)
    gap[over[:, 0]] += over[:, 1].astype(U64) << U64(16)
    return gap


META = np.dtype([("id", "<i8"), ("n", "<i8"), ("a", "<i8"), ("b", "<i8"), ("rep", "<i8"), ("null", "?")])


def _count(bits: int):
    """A bucket's tokens of two documents or more go back to their blocks with a class of their document count."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        bucket = table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        if bucket < 0:
            out = [(k, True, *(x.as_py() for x in row)) for k, *row in zip(blocks, *(table.column(c) for c in ("idx", "hi", "lo", "many")))]
        else:
            toks, idxs, held = [], [], []
            for a, h, low, many in zip(*(table.column(c) for c in ("idx", "hi", "lo", "many"))):
                idx, lo = np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(low.as_buffer(), np.uint32)
                hi = np.cumsum(unpacked_gaps(h.as_buffer(), len(lo)), dtype=U64)
                toks.append(U64(bucket) << U64(64 - bits) | hi << U64(32) | lo)
                idxs.append(idx)
                w = np.ones(len(idx), np.int64)
                w[idx == SEVERAL] = np.frombuffer(many.as_buffer(), np.uint16)
                held.append(w)
            size = [len(x) for x in toks]
            tok, idx, src = np.concatenate(toks), np.concatenate(idxs), np.repeat(np.arange(len(size)), size)
            toks.clear()
            by = np.argsort(tok, kind="stable")
            t = tok[by]
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            n = np.add.reduceat(np.concatenate(held)[by], edge[:-1])
            shared = np.repeat(n > 1, np.diff(edge))
            level = np.minimum(np.log2(np.repeat(n, np.diff(edge))[shared]) * 8, 255).astype(np.uint8)
            keep = by[shared]
            back = np.argsort(src[keep], kind="stable")
            keep, level = keep[back], level[back]
            cut = np.searchsorted(src[keep], np.arange(len(size) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                w = keep[cut[k] : cut[k + 1]]
                out.append((blocks[k], False, idx[w].tobytes(), tok[w].tobytes(), b"", level[cut[k] : cut[k + 1]].tobytes()))
        # of the block's own row tok, held_by and level are the hashes, documents and numbers of documents of its tokens in several
        cols = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), *[pa.binary()] * 4))], ["block", "meta", "idx", "tok", "held_by", "level"])

    return run


@lean
def _unpack_meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, m in zip(batch.column("block").to_pylist(), batch.column("idx")):
            r = np.frombuffer(m.as_buffer(), META)
            cols = [pa.array(r["id"], mask=r["null"]), pa.array(r["n"]), pa.array(r["a"]), pa.array(r["b"]), pa.array(r["rep"], mask=r["null"] | (r["n"] == 0)), pa.array(np.full(len(r), block))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "a", "b", "rep", "block"])


def ranked(tok: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """Positions of shared tokens in global order ``k``: order 0 is rarity, then hash; the others take the hash classes in turn, by rarity within."""
    h = mix(tok + STEPS[10 + k])
    return np.lexsort((h, level)) if k == 0 else np.lexsort((h, level, (h % U64(2 * k + 1) + U64(k)) % U64(2 * k + 1)))


def _prefixes(threshold: int):
    """Documents whose prefix holds shared tokens: (id, n, level, p0, tok, m0, m1, ...), of those that a block's ``reps`` name.

    ``tok`` holds the sorted shared tokens, and each mask a bit for each of them: whether it is in the prefix of that order.
    ``p0`` and ``level`` give the tokens of the first prefix and their classes to the posting lists, which read nothing else.
    """

    def mask(at: np.ndarray, size: int) -> bytes:
        bits = np.zeros(size, bool)
        bits[at] = True
        return np.packbits(bits).tobytes()

    def run(table: pa.Table) -> pa.Table:
        meta, reps, idxs, toks, levels = None, np.empty(0, np.int64), [], [], []
        for m, a, t, h, v, ids in zip(*(table.column(c) for c in ("meta", "idx", "tok", "held_by", "level", "reps"))):
            if ids.is_valid:
                reps = ids.values.to_numpy(zero_copy_only=False)
            elif m.as_py():
                meta = np.frombuffer(a.as_buffer(), META)
                own, docs, number = np.frombuffer(t.as_buffer(), U64), np.frombuffer(h.as_buffer(), np.uint16), np.frombuffer(v.as_buffer(), np.uint16).astype(np.int64)
            else:
                idxs.append(np.frombuffer(a.as_buffer(), np.uint16))
                toks.append(np.frombuffer(t.as_buffer(), U64))
                levels.append(np.frombuffer(v.as_buffer(), np.uint8))
        rows = []
        if toks:
            idx, tok, level = map(np.concatenate, (idxs, toks, levels))
            among = idx == SEVERAL
            if among.any():  # every token in several documents of the block is shared, so all of them came back
                by = np.argsort(tok[among], kind="stable")
                tok = np.concatenate([tok[~among], np.repeat(own, number)])
                level = np.concatenate([level[~among], np.repeat(level[among][by], number)])
                idx = np.concatenate([idx[~among], docs])
            by = np.lexsort((tok, idx))
            idx, tok, level = idx[by], tok[by], level[by]
            cut = np.searchsorted(idx, np.arange(len(meta) + 1))
            for i in np.flatnonzero((np.diff(cut) > 0) & np.isin(meta["id"], reps)):
                n, m = int(meta["n"][i]), int(cut[i + 1] - cut[i])
                take = n - -(-threshold * n // 100) + 1 - (n - m)
                if take > 0:
                    t, v = tok[cut[i] : cut[i + 1]], level[cut[i] : cut[i + 1]]
                    at = [ranked(t, v, k)[:take] for k in range(ORDERS)]
                    rows.append((int(meta["id"][i]), n, v[at[0]].tobytes(), t[at[0]].tobytes(), t.tobytes(), *(mask(x, len(t)) for x in at)))
        cols = list(zip(*rows)) or [[]] * (5 + ORDERS)
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64()] + [pa.binary()] * (3 + ORDERS))], ["id", "n", "level", "p0", "tok", *(f"m{k}" for k in range(ORDERS))])

    return run


@lean
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, id, n, s, c): the prefix tokens of each document; s is in how many parts the list of t is dealt, by how many hold it; c is the document's component."""
    for batch in batches:
        cols = [[], [], [], [], []]
        for i, n, c, v, p in zip(*(batch.column(x).to_pylist() for x in ("id", "n", "c")), batch.column("level"), batch.column("p0")):
            t = np.frombuffer(p.as_buffer(), np.int64)
            parts = np.ceil(np.exp2(np.frombuffer(v.as_buffer(), np.uint8) / 8) / SHARE).astype(np.int64)
            for col, x in zip(cols, (t, np.full(len(t), i), np.full(len(t), n), parts, np.full(len(t), c))):
                col.append(x)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["t", "id", "n", "s", "c"])


def postings(sets: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """A table of the lists of prefix tokens; documents without a label are components of their own."""
    held = sets.select("id", "n", "level", "p0")
    held = held.withColumn("c", F.col("id")) if label is None else held.join(label, "id", "left").withColumn("c", F.coalesce("component_id", "id"))
    return materialise(held.mapInArrow(_postings, "t bigint, id bigint, n bigint, s bigint, c bigint"), "postings")


def marked(tok: np.ndarray, mask: pa.Scalar) -> np.ndarray:
    """The tokens whose bit is set in a mask of ``_prefixes``."""
    return tok[np.unpackbits(np.frombuffer(mask.as_buffer(), np.uint8), count=len(tok)).view(bool)]


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _verify(threshold: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            keep = np.zeros(batch.num_rows, bool)
            for i, (na, nb) in enumerate(zip(col["n_a"].to_pylist(), col["n_b"].to_pylist())):
                a, b = (np.frombuffer(col[c][i].as_buffer(), U64) for c in ("tok_a", "tok_b"))
                if all(shared_count(marked(a, col[f"m{k}_a"][i]), marked(b, col[f"m{k}_b"][i])) for k in range(1, ORDERS)):
                    both = shared_count(a, b)
                    keep[i] = 100 * both >= threshold * (na + nb - both)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(keep))

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set of ``a`` with each of ``b``, by a product of incidence matrices."""
    both = np.intersect1d(np.concatenate([*a, np.empty(0, U64)]), np.concatenate([*b, np.empty(0, U64)]))
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]

        def incidence(sets: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                pos = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[i, pos[part[pos] == s]] = 1
            return m

        out += incidence(a) @ incidence(b).T
    return out


def _verify_blocks(threshold: int):
    """Verifies chunks against chunks. Of the links found, those of a spanning forest over the components so far are returned."""

    def side(x: pa.Array) -> dict[str, np.ndarray | list[np.ndarray]]:
        out = {c: x.field(c).to_numpy() for c in ("id", "n", "c")}
        tok = [np.frombuffer(v.as_buffer(), U64) for v in x.field("tok")]
        return out | {"tok": tok} | {f"p{k}": [marked(t, m) for t, m in zip(tok, x.field(f"m{k}"))] for k in range(ORDERS)}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (side(batch.column(c)[i].values) for c in ("l", "r"))
                big = np.maximum.outer(x["n"], y["n"])
                maybe = (np.minimum.outer(x["n"], y["n"]) * 100 >= big * threshold) & (x["c"][:, None] != y["c"][None, :])
                for k in range(ORDERS):
                    if maybe.any():
                        maybe &= _common(x[f"p{k}"], y[f"p{k}"]) > 0
                if not maybe.any():
                    continue
                both = _common(x["tok"], y["tok"]).astype(np.int64)
                linked = np.argwhere(maybe & (100 * both >= threshold * (np.add.outer(x["n"], y["n"]) - both)))
                ends = np.stack([x["c"][linked[:, 0]], y["c"][linked[:, 1]]], 1)
                _, first = np.unique(np.sort(ends, axis=1), axis=0, return_index=True)
                root: dict[int, int] = {}

                def find(v: int) -> int:
                    while (up := root.get(v, v)) != v:
                        root[v] = root.get(up, up)
                        v = up
                    return v

                keep = []
                for k in first.tolist():
                    a, b = find(int(ends[k, 0])), find(int(ends[k, 1]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        keep.append(k)
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(x["id"][linked[keep, 0]]), pa.array(y["id"][linked[keep, 1]])], ["a", "b"])

    return run


def part_of(col: str, parts: str) -> Column:
    """The part, of as many as ``parts`` says, in which a row meets what its hot key brings."""
    return F.pmod(F.xxhash64(col), F.col(parts)).alias("k")


def each_part(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1)).alias("k")


def _equal_sets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join the documents of each equal set, and for each block those ids that represent a set (block, reps)."""
    heads = members.where("rep is not null and id = rep").select("a", "b", "rep").distinct()
    parts = heads.withColumn("m", F.min("rep").over(Window.partitionBy("a", "b", F.pmod(F.xxhash64("rep"), F.lit(PARTS)))))
    tops = parts.where("rep = m").select("a", "b", "rep").withColumn("m", F.min("rep").over(Window.partitionBy("a", "b")))
    edge = lambda d, to: d.where(F.col("rep") != F.col(to)).select(F.col("rep").alias("a"), F.col(to).alias("b"))
    inside = members.where("rep is not null and id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    reps = tops.where("rep = m").select(F.col("rep").alias("id")).distinct()
    reps = members.where("id = rep").select("block", "id").join(reps, "id", "left_semi").groupBy("block").agg(F.collect_set("id").alias("reps"))
    return inside.unionByName(edge(parts, "m")).unionByName(edge(tops, "m")), reps


def _first_links(posts: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of each document with two leaders of each of its prefix tokens: the least id and the shortest document."""
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold
    both = F.array(F.struct(F.col("x.id").alias("lead"), F.col("x.n").alias("m")), F.struct(F.col("y.id").alias("lead"), F.col("y.n").alias("m")))
    leads = posts.groupBy("t").agg(F.min(F.struct("id", "n")).alias("x"), F.min(F.struct("n", "id")).alias("y"), F.count("*").alias("c"), F.max("s").alias("s")).where("c > 1")
    leads = leads.select("t", "s", "c", F.explode(F.array_distinct(both)).alias("z")).select("t", "s", "c", "z.*")
    parts = leads.groupBy("lead").agg(F.ceil(F.sum("c") / SHARE).alias("parts"))  # a leader leads no more lists than it has prefix tokens
    leads = leads.join(parts, "lead").select("t", "lead", "m", "parts", each_part("s"))
    star = posts.select("t", "id", "n", part_of("id", "s")).join(leads, ["t", "k"]).where(fits & (F.col("id") != F.col("lead")))
    # a pair of two leaders is verified once
    star = star.groupBy(F.least("id", "lead").alias("lo"), F.greatest("id", "lead").alias("hi")).agg(F.min(F.struct("lead", "parts")).alias("z"))
    pairs = star.select(F.col("z.lead").alias("a"), F.when(F.col("z.lead") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), F.col("z.parts").alias("parts"))
    pairs = pairs.select("a", "b", part_of("b", "parts"))
    held = ["n", "tok", *(f"m{k}" for k in range(1, ORDERS))]  # they share a token of the first prefix
    sets = sets.select("id", *held)  # both joins take it as it is, so that one exchange serves them
    side = lambda x: [F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in held)]
    led = sets.join(parts.select(F.col("lead").alias("id"), "parts"), "id").select(*side("a"), each_part("parts"))
    pairs = pairs.withColumnRenamed("b", "id").join(sets, "id").select("a", "k", *side("b"))
    return pairs.join(led, ["a", "k"]).mapInArrow(_verify(threshold), "a bigint, b bigint")


def _second_links(posts: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components of the first links, from lists of prefix tokens that hold several; a table."""
    mixed = posts.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("leader"), F.count("*").alias("held"), F.max("s").alias("s")).where("lo < hi")
    mixed = mixed.join(mixed.groupBy("leader").agg(F.ceil(F.sum("held") / SHARE).alias("parts")), "leader")
    groups = posts.select("t", "id", "n", "c", part_of("id", "s")).join(mixed.select("t", "leader", "parts", each_part("s")), ["t", "k"])
    groups = materialise(groups.select("leader", "parts", "id", "n", "c").distinct(), "groups")
    chunks = groups.groupBy("leader").agg(F.max("parts").alias("parts"), F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS)).alias("chunks"))
    dealt = groups.select("leader", "id", "c", part_of("id", "parts")).join(chunks.select("leader", "chunks", each_part("parts")), ["leader", "k"])
    dealt = dealt.drop("k").join(sets.drop("level", "p0"), "id").groupBy("leader", F.pmod(F.xxhash64("id"), "chunks").alias("k"))
    one = F.struct("id", "n", "c", "tok", *(f"m{k}" for k in range(ORDERS)))
    dealt = materialise(dealt.agg(F.collect_list(one).alias("x"), F.min("c").alias("lo"), F.max("c").alias("hi")), "chunks")
    # sixteen chunks of a leader meet all that don't come before them in one task
    l = dealt.select("leader", (F.col("k") / 16).cast("bigint").alias("g"), "k", "x", "lo", "hi").alias("l")
    r = dealt.select("leader", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("k") / 16).cast("bigint"))).alias("g"), "k", "x", "lo", "hi").alias("r")
    pairs = l.join(r, (F.col("l.leader") == F.col("r.leader")) & (F.col("l.g") == F.col("r.g")) & (F.col("l.k") <= F.col("r.k")) & (F.least("l.lo", "r.lo") < F.greatest("l.hi", "r.hi")))
    found = materialise(pairs.select(F.col("l.x").alias("l"), F.col("r.x").alias("r")).mapInArrow(_verify_blocks(threshold), "a bigint, b bigint"), "second")
    drop_tables(groups, dealt)
    return found


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, n_shingles, component_id)``.

    Links are pairs with ``100 * |x & y| >= threshold * |x | y|`` on sets of ``width``-word shingles (A-Z
    lower-cased, words split at ASCII white space); ``component_id`` is the smallest id that links reach.
    Null and empty texts, and texts without words, have 0 shingles and link with nothing, not with each
    other. Repeated rows give a row each, with one component. Rows with a null id get a null component.
    An empty table gives an empty result. Other columns are ignored. Ids are 64-bit integers; of rows with
    one id and several texts each text is a version, and what links to any of them is in its component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # no statistics (not read from files): count instead of guessing
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(18, max(6, (size >> 23).bit_length()))
    scanned = docs.mapInArrow(_scan("id", "text", width, bits), "bucket int, block bigint, idx binary, hi binary, lo binary, many binary")
    counted = materialise(scanned.groupBy("bucket").applyInArrow(_count(bits), "block bigint, meta boolean, idx binary, tok binary, held_by binary, level binary"), "shared")
    members = counted.where("meta").select("block", "idx").mapInArrow(_unpack_meta, "id bigint, n bigint, a bigint, b bigint, rep bigint, block bigint")
    members = materialise(members, "members")
    same, reps = _equal_sets(members)
    schema = "id bigint, n bigint, level binary, p0 binary, tok binary, " + ", ".join(f"m{k} binary" for k in range(ORDERS))
    known = counted.unionByName(reps, allowMissingColumns=True)  # a block hears which of its sets stay, so that no set travels for it
    sets = materialise(known.groupBy("block").applyInArrow(_prefixes(threshold), schema), "sets")
    drop_tables(counted)
    posts = postings(sets)
    label = components(_first_links(posts, sets, threshold), src="a", dst="b")
    drop_tables(posts)
    posts = postings(sets, label)
    second = _second_links(posts, sets, threshold)
    # links, classes and versions of one id together
    joined = label.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    label = components(joined.unionByName(second).unionByName(same), src="a", dst="b")
    drop_tables(posts, sets, second)
    out = members.select("id", "n").join(label, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns kept.

    Rows without shingles and rows with a null id stay. Of rows that repeat an id and its text one stays; different
    texts under one id are versions, and all of them stay.
    """
    found = materialise(ngram_jaccard_components(docs, id_col, text_col, width, threshold), "found")
    key, columns = f"`{id_col}`", [F.col(f"`{c}`") for c in docs.columns]
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*columns)
    again = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if again.isEmpty():
        return kept
    return kept.join(again, id_col, "left_anti").select(*columns).unionByName(kept.join(again, id_col, "left_semi").select(*columns).dropDuplicates([id_col, text_col]))

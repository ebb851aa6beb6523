"""BPE encoding and decoding by speculation and verification.

A sequence of tokens is what BPE makes of a word if and only if each token is what BPE makes of its own
text and no merge would ever cross the border of two neighbours. So greedy longest matches propose the
tokens of all new words at once (a walk of all words through one trie), array operations test every
adjacent pair, and only words with a failing pair undergo exact merging.

Pair test: undo both tokens' merges, latest first. At each moment the border lies between two parts x and y;
their merge would cross if its rank is below the one that uses up x, and not above the one that uses up y
(equal ranks go from left to right). Merges must be in training order: a pair's parts come before it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, slices, small_batches
from .words import WordTable, plain_rows, split

NEVER = np.int64(1 << 60)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a public rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class SpeculativeBPE:
    """Encoder for a byte-level BPE vocabulary with an end-of-word suffix, from a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter, for rows beyond Latin-1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        chars = byte_symbols()
        # symbols 0-255: a byte; 256-511: the last byte of a word
        self.symbol = np.array([vocab.get(c, -1) for c in chars] + [vocab.get(c + self.suffix, -1) for c in chars])
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        a, b, c = (np.array([vocab[f(m)] for m in merges]) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        rank = np.arange(len(merges), dtype=np.int64)
        self.made = np.full(self.size, -1, np.int64)  # rank of the merge that makes a token
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.made[c[::-1]], self.left[c[::-1]], self.right[c[::-1]] = rank[::-1], a[::-1], b[::-1]
        by = np.argsort(a * self.size + b, kind="stable")
        self.pairs, self.pair_rank = (a * self.size + b)[by], rank[by]
        self.made_token = c
        self._trie(vocab, {c: i for i, c in enumerate(chars)})
        self.table = WordTable(self.words)

    def _trie(self, vocab: dict[str, int], byte: dict[str, int]) -> None:
        """Nodes as sorted keys (parent * 512 + symbol), for tokens that BPE makes of their own text."""
        ids = np.array(sorted(vocab.values()))
        good = np.ones(self.size, bool)
        merged = ids[self.made[ids] >= 0]
        merged = merged[np.argsort(self.made[merged])]
        own = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        for i, ok in zip(merged.tolist(), own.tolist()):  # parts come before
            good[i] = ok and good[self.left[i]] and good[self.right[i]]
        nodes: dict[int, int] = {}
        token = [-1]
        for t, i in vocab.items():
            if not good[i]:
                continue
            last = bool(self.suffix) and t.endswith(self.suffix)
            body = t[: -len(self.suffix)] if last else t
            if not body or any(ch not in byte for ch in body):
                continue
            at = 0
            for k, ch in enumerate(body):
                key = at * 512 + byte[ch] + 256 * (last and k == len(body) - 1)
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                at = nodes[key]
            token[at] = i
        keys = np.array(sorted(nodes))
        self.node_keys, self.node_next, self.node_token = keys, np.array([nodes[k] for k in keys.tolist()]), np.array(token)

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether no merge (of a rank below ``limit``) ever crosses their border."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        end_x = np.full(len(x), NEVER) if limit is None else limit.copy()
        end_y = np.full(len(x), NEVER) if limit is None else limit - 1
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            at = np.minimum(np.searchsorted(self.pairs, u * self.size + v), len(self.pairs) - 1)
            r = np.where(self.pairs[at] == u * self.size + v, self.pair_rank[at], NEVER)
            crossed = (r < end_x[live]) & (r <= end_y[live])
            ok[live[crossed]] = False
            mu, mv = self.made[u], self.made[v]
            more = ~crossed & ((mu >= 0) | (mv >= 0))
            undo_x = more & (mu > mv)
            undo_y = more & ~undo_x
            i, j = live[undo_x], live[undo_y]
            end_x[i], x[i] = mu[undo_x], self.right[u[undo_x]]
            end_y[j], y[j] = mv[undo_y], self.left[v[undo_y]]
            live = live[more]
        return ok

    def merge(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each round each word merges its pairs of lowest rank, left to right."""
        done_ids, done_word = [], []
        while len(ids):
            pair = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            r = np.full(len(ids), NEVER)
            r[:-1] = np.where((self.pairs[at] == pair) & (word[:-1] == word[1:]), self.pair_rank[at], NEVER)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            low = np.repeat(np.minimum.reduceat(r, first), size)
            over = low == NEVER
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = (r == low) & ~over
            # of pairs that share a token every other one, from the left
            prev = np.concatenate([[False], hit[:-1]])
            run = np.flatnonzero(hit & ~prev)
            pos = np.arange(len(ids))
            nth = pos - run[np.maximum(np.searchsorted(run, pos, side="right") - 1, 0)] if len(run) else pos
            hit &= nth % 2 == 0
            at = np.flatnonzero(hit)
            ids = ids.copy()
            ids[at] = self.made_token[r[at]]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            keep = ~gone & ~over
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate([*done_ids, np.empty(0, np.int64)]), np.concatenate([*done_word, np.empty(0, np.int64)])
        by = np.argsort(word, kind="stable")
        return ids[by], word[by]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words end to end, and how many each has."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(n)
        sym = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.suffix:
            sym[end - 1] += 256
        # speculate: all words walk the trie at once; a cursor that can't go on takes its longest token
        cur = end - n
        node, best, best_end = np.zeros(len(n), np.int64), np.full(len(n), -1), cur.copy()
        begin, live = cur.copy(), np.flatnonzero(n > 0)
        got_word, got_at, got_token = [], [], []
        failed = np.zeros(len(n), bool)
        while len(live):
            at_end = cur[live] >= end[live]
            key = node[live] * 512 + sym[np.minimum(cur[live], len(sym) - 1)]
            at = np.minimum(np.searchsorted(self.node_keys, key), len(self.node_keys) - 1)
            on = ~at_end & (self.node_keys[at] == key)
            w = live[on]
            node[w] = self.node_next[at[on]]
            cur[w] += 1
            t = self.node_token[node[w]]
            hit = w[t >= 0]
            best[hit], best_end[hit] = t[t >= 0], cur[hit]
            w = live[~on]
            bad = best[w] < 0
            failed[w[bad]] = True
            w = w[~bad]
            got_word.append(w)
            got_at.append(begin[w])
            got_token.append(best[w])
            cur[w] = begin[w] = best_end[w]
            node[w], best[w] = 0, -1
            live = np.flatnonzero((cur < end) | (begin < end)) if len(bad) else live
            live = live[~failed[live]]
        word, at, token = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (got_word, got_at, got_token))
        by = np.argsort(at, kind="stable")
        word, token = word[by], token[by]
        # verify every adjacent pair of a word
        same = np.flatnonzero(word[1:] == word[:-1])
        key, inv = np.unique(token[same] * self.size + token[same + 1], return_inverse=True)
        ok = self.compatible(key // self.size, key % self.size)[inv]
        failed[word[same[~ok]]] = True
        keep = ~failed[word]
        word, token = word[keep], token[keep]
        fail = np.flatnonzero(failed)
        if len(fail):
            who = np.repeat(np.arange(len(n)), n)
            take = failed[who]
            ids = self.symbol[sym[take]]
            there = ids >= 0
            token2, word2 = self.merge(ids[there], who[take][there])
            word, token = np.concatenate([word, word2]), np.concatenate([token, token2])
            by = np.argsort(word, kind="stable")
            word, token = word[by], token[by]
        return token.astype(np.uint32), np.bincount(word, minlength=len(n)).astype(np.int32)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each row; null is empty."""
        data, offsets = flat(texts)
        data = data.copy()
        raw = data.tobytes()
        plain = plain_rows(data, offsets)
        if any(s.encode() in raw for s in self.special):
            plain &= np.array([not any(s.encode() in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1], offsets[1:])], bool)
        upper = (data >= 65) & (data <= 90)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[upper] += 32
        starts, ends = split(data, offsets, keep_space=False)
        if not plain.all():
            ok = plain[np.searchsorted(offsets, starts, side="right") - 1]
            starts, ends = starts[ok], ends[ok]
        ids, size = self.table.lookup(data, starts, ends)
        at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        for i in np.flatnonzero(~plain):
            out[i] = self.any_text(raw[offsets[i] : offsets[i + 1]].decode())
        return out

    def any_text(self, text: str) -> np.ndarray:
        """A text with any characters: special tokens first, then the library's normaliser and splitter, then our merging."""
        import re

        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        out = []
        byte = {c: i for i, c in enumerate(byte_symbols())}
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], np.uint32))
            elif part:
                words = [bytes(byte[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                if words:
                    out.append(self.words(words)[0])
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary has no decoder of its own: tokens with a space between."""
        return " ".join(map(self.text.__getitem__, ids.tolist()))


@cache
def encoder(path: str) -> SpeculativeBPE:
    """One for each Python worker."""
    return SpeculativeBPE(path)


def encode_documents(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` (array of long) and ``decoded`` appended.

    Null texts count as empty: no ids, decoded empty. Texts of any length and any characters are encoded
    whole; repeated rows get equal ids; other columns pass through (input columns named like the two
    outputs are replaced); an empty table gives an empty result.
    """
    return _run(docs, tokenizer, text_col, "ids array<bigint>, decoded string", lambda e, ids: [pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), pa.array([e.decode(x) for x in ids], pa.string())])


def digest_documents(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the ids."""

    def out(e: SpeculativeBPE, ids: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(e.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _run(docs, tokenizer, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", out)


def _run(docs: DataFrame, tokenizer: str, text_col: str, more: str, out) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in more.split(", ")]
    rest = [f for f in docs.schema.fields if f.name not in (text_col, *names)]
    # the text comes first and is told by its place, so no column's name is reserved
    docs = docs.select(F.col(f"`{text_col}`").cast("string"), *(F.col(f"`{f.name}`") for f in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            for piece in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], *out(e, e(piece.column(0)))], [*piece.schema.names[1:], *names])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), more]))

"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols, stale entries skipped.

Decoding concatenates the vocabulary's byte strings. The vocabulary file is a parameter: the driver reads it and sends
it to the executors (its size is fixed). Each distinct pre-token is merged once per worker while it stays in a bounded
memo; memo or not, the ids are the same.

Defined cases: null text is empty and has no ids; strings of added tokens in a text become those tokens; long runs
without a break are merged whole, in n log n; rows, repeated or not, are independent; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, lean_batches, without

#: The published pattern that splits text before merging (a fixed value of the file's pre-tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers, and the longest one that it does.
MEMO, MEMO_CHARS = 500_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the file: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class Bpe(dict):
    """Maps a pre-token to its ids (little-endian unsigned 32-bit)."""

    def __init__(self, spec: bytes) -> None:
        super().__init__()
        made = json.loads(spec)
        vocab, chars = made["model"]["vocab"], byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.first = [vocab.get(c) for c in chars]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(made["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.strings = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = b"".join(back[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        sym = [self.first[b] for b in piece]
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j], k = new, -1, nxt[j]
            nxt[i] = k
            if k >= 0:
                prv[k] = i
                if r := ranks.get((new, sym[k])):
                    heapq.heappush(queue, (r[0], i, new, sym[k], r[1]))
            h = prv[i]
            if h >= 0 and (r := ranks.get((sym[h], new))):
                heapq.heappush(queue, (r[0], h, sym[h], new, r[1]))
        return [s for s in sym if s >= 0]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special and len(found := self.special(text)) > 1:
            return b"".join(np.array([self.added[x]], "<u4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(found))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return b"".join([self[w] for w in self.split(text)])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _model(sent) -> Bpe:
    """This worker's model, kept between tasks."""
    spec = sent.value
    key = hashlib.sha256(spec).digest()
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Bpe(spec)
    return KEPT[key]


def _send(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of text_col as array<long> (null text: an empty array)."""
    df = without(df, out)
    sent, names = _send(df, path), df.columns
    at = [n.lower() for n in names].index(text_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb in batches:
            ids = [np.frombuffer(model.encode(t or ""), "<u4").astype(np.int64) for t in rb.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(ids, pa.list_(pa.int64()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean_batches(rows, keep=True), f"{fields}, `{out}` array<long>")


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the string that ids_col (an array of ids) stands for (null: empty)."""
    df = without(df, out)
    sent, names = _send(df, path), df.columns
    at = [n.lower() for n in names].index(ids_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb in batches:
            texts = [model.decode(np.array(i or [], "<u4").tobytes()) for i in rb.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(texts, pa.string())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean_batches(rows, keep=True), f"{fields}, `{out}` string")


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, then decodes its ids."""
    sent = _send(df, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb in batches:
            n, ids_sha, text_sha = [], [], []
            for t in rb.column(1):
                ids = model.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = df.select(df[id_col], df[text_col].cast("string"))
    return kept.mapInArrow(lean_batches(rows, keep=True), f"`{id_col}` {kept.schema.fields[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

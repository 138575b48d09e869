"""Cross-tokenizer alignment: where tokens of two vocabularies end together, and how often each pair of ids does.

Tokens of A (byte-level BPE, on space+text) and of B (pieces with byte fallback, which add that space) are laid over
the same bytes. Ends are running sums of token lengths; the common cuts of both end lists part the text into groups;
labels of tokens come from a binary search among the cuts; links are an expansion by repeats. All of this is done for a
lot of documents at once. Counts of id pairs are added up in lots, then by (bucket of B ids, salt), then by bucket, and
go back the same way: what moves are a lot's distinct pairs, never a row for each link.

Texts are cut before a space that follows no white space. Neither vocabulary has a token across such a place (checked
for B's pieces; A's pattern never spans one), so the pieces encode as the whole text does, and repeated ones once only.

Defined cases: texts that are null or empty, or whose tokens don't spell space+text (U+2581 in it, say), have no tokens
and zeros in all columns; strings of special tokens are plain text; rows, repeated or not, are independent, whatever
their id; an empty table gives an empty one; a text longer than a lot is a lot of its own.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import KEPT, U, lean, lean_batches, materialize, mix, pack, task_id, unpack

#: Bytes of text that are aligned at once, pieces that a worker remembers and the longest one that it does.
LOT, MEMO, MEMO_CHARS = 2 << 20, 500_000, 64
#: What marks a piece that its ids don't spell.
ODD = 1 << 30
#: Pieces that the libraries encode at once: their results take far more room than ids.
TOGETHER = 2048
#: Most buckets of pairs: the vocabularies, not the texts, bound how many pairs there are.
MOST_BUCKETS = 512
SCOPES = ("ends", "group")
#: White space of any kind (a text that has one before a space takes the longer way to its pieces).
BLANK = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def ends_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths, dtype=np.int64)


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts, and each token's group (the first cut at or after its end)."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def expand(label_a: np.ndarray, label_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all pairs with equal labels; both sorted."""
    lo, hi = np.searchsorted(label_b, label_a), np.searchsorted(label_b, label_a, "right")
    n = hi - lo
    first = np.cumsum(n) - n
    return np.repeat(np.arange(len(label_a)), n), np.arange(int(n.sum())) + np.repeat(lo - first, n)


def links(ends_a: np.ndarray, ends_b: np.ndarray, scope: str = "ends") -> tuple[np.ndarray, np.ndarray]:
    """Token positions (in a, in b) linked: those that end together, or (scope "group") all within a group."""
    cuts, la, lb = cut_groups(ends_a, ends_b)
    if scope == "group":
        return expand(la, lb)
    at_a, at_b = np.flatnonzero(cuts[la] == ends_a), np.flatnonzero(cuts[lb] == ends_b)
    i, j = expand(la[at_a], lb[at_b])
    return at_a[i], at_b[j]


class Both(dict):
    """Maps a piece of text to A's and B's ids (see learn); remembers a bounded number of pieces."""

    def __init__(self, spec_a: bytes, spec_b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(spec_a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on after a space, so texts can't be cut there")
        self.space = self.b.piece_to_id("▁")
        shown = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        #: What stands for a token in the groups' text: an A id within and at the end of its side, then a B id.
        self.shown = [*(s + "," for s in shown), *(s + "|" for s in shown), *(s + "," for s in shown), *(s + ";" for s in shown)]
        self.step = len(shown)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """For each piece (its leading space left out) 32-bit numbers: how many ids A has (plus ODD if the ids don't spell it), A's ids, B's ids."""
        if not pieces:
            return {}
        raw = [(" " + p).encode() for p in pieces]
        a = []
        for i in range(0, len(pieces), TOGETHER):
            a += [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces[i : i + TOGETHER]], add_special_tokens=False)]
        b = [ids or [self.space] for ids in self.b.encode(pieces, num_threads=1)]
        n = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b)]
        size, whole, odd = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))), b"".join(raw), np.zeros(len(pieces), bool)
        total = 1 + n[0] + n[1]
        end = np.cumsum(total)
        out, first = np.empty(int(end[-1]), "<i4"), end - total + 1
        for ids, many, strings, sizes in ((a, n[0], self.bytes_a, self.len_a), (b, n[1], self.bytes_b, self.len_b)):
            flat = list(chain.from_iterable(ids))
            numbers, last = np.array(flat, np.int64), np.cumsum(many)
            if not np.array_equal(np.r_[0, np.cumsum(sizes[numbers])][last], size) or b"".join([strings[i] for i in flat]) != whole:
                odd |= [b"".join([strings[i] for i in x]) != r for x, r in zip(ids, raw, strict=True)]
            out[np.arange(len(flat)) + np.repeat(first - (last - many), many)] = numbers
            first = first + many
        out[end - total] = n[0] + odd * ODD
        held, edge = out.tobytes(), (4 * end).tolist()
        return dict(zip(pieces, [held[i:j] for i, j in zip([0, *edge], edge, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all texts, and how many each text has; none where they don't spell space+text. New pieces are encoded together."""
        cut = [pieces_of(t) if t else [] for t in texts]
        new = {p for c in cut for p in c if p not in self}
        if len(self) + len(new) > MEMO:
            self.clear()
            new = {p for c in cut for p in c}
        long = self.learn([p for p in new if len(p) > MEMO_CHARS])
        short = [p for p in new if len(p) <= MEMO_CHARS]
        for i in range(0, len(short), 16 * TOGETHER):
            self.update(self.learn(short[i : i + 16 * TOGETHER]))
        get = self.get
        held = [get(p) or long[p] for c in cut for p in c]
        flat = np.frombuffer(b"".join(held), "<i4")
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        start = np.cumsum(size) - size
        head = flat[start].astype(np.int64)
        n_a = head % ODD
        text = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        place = np.arange(len(flat)) - np.repeat(start, size)
        is_a = (place > 0) & (place <= np.repeat(n_a, size))
        is_b = place > np.repeat(n_a, size)
        n_b = size - 1 - n_a
        edge = np.r_[0, np.cumsum(size)][np.searchsorted(text, np.arange(len(texts) + 1))]
        for t in np.unique(text[head >= ODD]).tolist():
            span, raw = slice(edge[t], edge[t + 1]), (" " + texts[t]).encode()
            if any(b"".join([strings[i] for i in flat[span][some[span]].tolist()]) != raw for some, strings in ((is_a, self.bytes_a), (is_b, self.bytes_b))):
                is_a[span] = is_b[span] = False
                n_a[text == t] = n_b[text == t] = 0
        many = [np.bincount(text, x, len(texts)).astype(np.int64) for x in (n_a, n_b)]
        return flat[is_a], flat[is_b], *many


def pieces_of(text: str) -> list[str]:
    """space+text cut before each space that follows no white space; each piece without the space it starts with."""
    cut = text.split(" ")
    if text[0] != " " and not any(c + " " in text for c in BLANK):
        return cut
    out, held = [], [cut[0]]
    for p in cut[1:]:
        if not held[-1] or held[-1][-1].isspace():
            held.append(p)
        else:
            out.append(" ".join(held))
            held = [p]
    out.append(" ".join(held))
    return out


def _model(sent) -> Both:
    specs = sent.value
    key = hashlib.sha256(b"".join(specs)).digest()
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Both(*specs)
    return KEPT[key]


def _send(df: DataFrame, path_a: str, path_b: str):
    specs = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            specs.append(f.read())
    return df.sparkSession.sparkContext.broadcast(specs)


def lots_of(batches: Iterator[pa.RecordBatch], limit: int = LOT) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of a batch's first two columns, some limit of bytes at a time; null texts are empty."""
    ids, texts, held = [], [], 0
    for rb in batches:
        start = 0
        for i, t in enumerate(rb.column(1)):
            t = t.as_py() or ""
            texts.append(t)
            held += len(t.encode()) if not t.isascii() else len(t)
            if held >= limit:
                ids.append(rb.column(0).slice(start, i + 1 - start))
                yield pa.concat_arrays(ids), texts
                ids, texts, held, start = [], [], 0, i + 1
        ids.append(rb.column(0).slice(start))
    if texts:
        yield pa.concat_arrays(ids), texts


class Lot:
    """A lot's tokens, groups and links; documents are spans of each."""

    def __init__(self, model: Both, texts: list[str], scope: str) -> None:
        self.a, self.b, self.n_a, self.n_b = model.encode(texts)
        self.ends_a, self.ends_b = ends_of(model.len_a[self.a]), ends_of(model.len_b[self.b])
        size = np.r_[0, self.ends_a][np.cumsum(self.n_a)]  # bytes up to the end of each document
        self.cuts, self.group_a, self.group_b = cut_groups(self.ends_a, self.ends_b)
        self.group_end = np.searchsorted(self.cuts, size, "right")
        i, j = links(self.ends_a, self.ends_b, scope)
        self.i, self.j, self.size = i, j, size
        self.link_end = np.searchsorted(self.ends_a[i], size, "right")

    def texts(self, model: Both) -> Iterator[str]:
        """The groups of each document as a1,a2|b1;a3|b2,b3."""
        n, m, step = len(self.a), len(self.b), model.step
        last_a, last_b = (np.r_[g[1:] != g[:-1], [True] * bool(len(g))].astype(np.int64) for g in (self.group_a, self.group_b))
        place = np.empty(n + m, np.int64)
        place[np.arange(n) + np.searchsorted(self.group_b, self.group_a)] = self.a + last_a * step
        place[np.arange(m) + np.searchsorted(self.group_a, self.group_b, "right")] = self.b + (2 + last_b) * step
        at, shown = 0, model.shown
        for k in (self.n_a + self.n_b).tolist():
            yield "".join([shown[c] for c in place[at : at + k].tolist()])[:-1]
            at += k


def token_groups(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", out: str = "groups") -> DataFrame:
    """df with an array of groups: the byte span in space+text, A's ids and B's ids."""
    sent = _send(df, path_a, path_b)
    kept = df.select(*[df[c] for c in df.columns if c.lower() != out.lower()])
    names = kept.columns
    at = [n.lower() for n in names].index(text_col.lower())
    ints = pa.list_(pa.int32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for rb in batches:
            out_rows = []
            for t in rb.column(at):
                lot = Lot(model, [t.as_py() or ""], "ends")
                start = np.r_[0, lot.cuts[:-1]] if len(lot.cuts) else lot.cuts
                sides = [np.split(ids, np.searchsorted(g, np.arange(1, len(lot.cuts)))) if len(lot.cuts) else [] for ids, g in ((lot.a, lot.group_a), (lot.b, lot.group_b))]
                out_rows.append([{"start": int(s), "end": int(e), "a": a.tolist(), "b": b.tolist()} for s, e, a, b in zip(start, lot.cuts, *sides, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", ints), ("b", ints)]))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out_rows, kind)], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lean_batches(rows, keep=True), f"{fields}, `{out}` array<struct<start: bigint, `end`: bigint, a: array<int>, b: array<int>>>")


def _lots(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, scope: str, buckets: int) -> DataFrame:
    """A lot as a row with its documents (bucket -1), and a row for each bucket of its pairs."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    sent = _send(df, path_a, path_b)
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        width = len(model.bytes_b)
        for number, (ids, texts) in enumerate(lots_of(batches)):
            lot = Lot(model, texts, scope)
            shas = np.frombuffer(b"".join([hashlib.sha256(t.encode()).digest() if t else bytes(32) for t in lot.texts(model)]), np.uint8)
            keys, inverse, n = np.unique(lot.a[lot.i].astype(np.int64) * width + lot.b[lot.j], return_inverse=True, return_counts=True)
            doc = np.searchsorted(lot.size, lot.ends_a[lot.i])
            own = np.sort(doc * max(len(keys), 1) + inverse) % max(len(keys), 1)  # by document, then by pair
            steps = np.diff(own, prepend=0).astype(np.int32)
            own = (task_id() << 32) | number
            blob = pack(lot.n_a.astype(np.int32), lot.n_b.astype(np.int32), np.diff(lot.group_end, prepend=0).astype(np.int32), np.diff(lot.link_end, prepend=0).astype(np.int32), shas, steps, keys.view(U) % U(width))
            bucket = bucket_of(keys % width, buckets)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            held = [b for b in range(buckets) if edge[b] < edge[b + 1]]
            packed = [pack(np.diff(keys[by[edge[b] : edge[b + 1]]], prepend=0), n[by[edge[b] : edge[b + 1]]]) for b in held]
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            lists = pa.concat_arrays([one, pa.nulls(len(held), one.type)])
            yield pa.RecordBatch.from_arrays([pa.array([own] * (len(held) + 1), pa.int64()), pa.array([-1, *held], pa.int32()), lists, pa.array([blob, *[None] * len(held)], pa.binary()), pa.array([None, *packed], pa.binary())], ["lot", "bucket", "ids", "blob", "part"])

    kind = kept.schema.fields[0].dataType.simpleString()
    return kept.mapInArrow(lean_batches(rows, keep=True), f"lot long, bucket int, ids array<{kind}>, blob binary, part binary")


def bucket_of(b: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of a B id share a bucket, so that its highest count is known there."""
    return (mix(b.astype(U) + U(1)) % U(buckets)).astype(np.int64)


def _add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in held]))
    return keys, total


def _adder(by: list[str]):
    """Rows sorted by their keys, with the pairs of each key added up; a few million entries are held."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            keys, n = _add(held)
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in now), pa.array([pack(np.diff(keys, prepend=0), n)], pa.binary())], [*by, "part"])

        for rb in batches:
            columns = [rb.column(c).to_pylist() for c in by]
            for i, part in enumerate(rb.column(len(by))):
                key = tuple(c[i] for c in columns)
                if key != now:
                    if now is not None:
                        yield out()
                    now, held, size = key, [], 0
                steps, n = unpack(part.as_py())
                held.append((np.cumsum(steps), n))
                size += len(n)
                if size > (4 << 20) and len(held) > 1:
                    held = [_add(held)]
                    size = len(held[0][0]) // 2
        if now is not None:
            yield out()

    return lean_batches(rows)


def _counted(lots: DataFrame, salts: int) -> DataFrame:
    """(bucket, part): corpus-wide counts, by (bucket, salt) first and then by bucket."""
    parts = lots.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("lot"), F.lit(salts)).cast("int").alias("salt"), "part")
    some = parts.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_adder(["bucket", "salt"]), "bucket int, salt int, part binary")
    return some.select("bucket", "part").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_adder(["bucket"]), "bucket int, part binary")


def _prepared(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, scope: str) -> tuple[DataFrame, DataFrame, int, int]:
    held = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(16, held // (32 << 20)))
    lots = materialize(_lots(df, path_a, path_b, id_col, text_col, scope, buckets), "lots")
    salts = max(1, math.isqrt(lots.where("bucket < 0").count()))
    return lots, materialize(_counted(lots, salts), "pairs"), salts, buckets


def _best(keys: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    b, at = np.unique(keys % width, return_inverse=True)
    most = np.zeros(len(b), np.int64)
    np.maximum.at(most, at, n)
    return n == most[at]


def _width(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def pair_counts(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", scope: str = "ends") -> DataFrame:
    """(a_id, b_id, n, best): links that hold each pair of ids, and whether no other pair of the B id has more."""
    _, counted, _, _ = _prepared(df, path_a, path_b, id_col, text_col, scope)
    width = _width(path_b)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for part in rb.column(0):
                steps, n = unpack(part.as_py())
                keys = np.cumsum(steps)
                yield pa.RecordBatch.from_arrays([pa.array(keys // width, pa.int32()), pa.array(keys % width, pa.int32()), pa.array(n), pa.array(_best(keys, n, width))], ["a_id", "b_id", "n", "best"])

    return counted.select("part").mapInArrow(lean_batches(rows), "a_id int, b_id int, n long, best boolean")


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", scope: str = "ends") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    lots, counted, salts, buckets = _prepared(df, path_a, path_b, id_col, text_col, scope)
    width = _width(path_b)

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        steps, n = unpack(known["part"][0].as_py())
        keys = np.cumsum(steps)
        best = _best(keys, n, width)
        out = []
        for part in asked["part"]:
            at = np.searchsorted(keys, np.cumsum(unpack(part.as_py())[0]))
            out.append(pack(n[at], best[at].astype(np.uint8)))
        return pa.table({"lot": asked["lot"], "bucket": asked["bucket"], "part": pa.array(out, pa.binary())})

    salt = F.pmod(F.xxhash64("lot"), F.lit(salts)).cast("int")
    asked = lots.where("bucket >= 0").select("lot", "bucket", salt.alias("salt"), "part")
    known = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = asked.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(lambda x, y: lean(lambda t: look_up(t, y))(x), "lot long, bucket int, part binary")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def gather(lot: pa.Table, got: pa.Table) -> pa.Table:
        n_a, n_b, n_groups, n_links, shas, steps, b = unpack(lot["blob"][0].as_py())
        n, best = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        if len(got):
            bucket = bucket_of(b.astype(np.int64), buckets)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for name, part in zip(got["bucket"].to_pylist(), got["part"], strict=True):
                at = by[edge[name] : edge[name + 1]]
                n[at], best[at] = unpack(part.as_py())
        at = np.cumsum(steps)
        end = np.cumsum(n_links)
        sums = [np.r_[0, np.cumsum(v[at])] for v in (best, n)]
        sums = [s[end] - s[end - n_links] for s in sums]
        shown = [x.hex() if k else "" for x, k in zip(np.ascontiguousarray(shas).reshape(-1, 32), n_a, strict=True) for x in [x.tobytes()]]
        ids = lot["ids"].combine_chunks().flatten()
        longs = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links, *sums)]
        return pa.table([ids, *longs, pa.array(shown, pa.string())], names)

    kind = df.select(df[id_col]).dtypes[0][1]
    whole = lots.where("bucket < 0").select("lot", "ids", "blob")
    return whole.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(lambda x, y: lean(lambda t: gather(t, y))(x), f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

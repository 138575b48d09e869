"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Only suffixes that can matter are sorted. Of every window of 200 bytes the k-byte gram of least hash is its anchor, so
equal windows have equal anchors at equal offsets; anchors whose gram occurs once drop out in an exchange of packed
hashes. For the others, each task sorts the suffixes at its anchors (with the bytes to the left, reversed, beside
them), front-codes the sorted runs and deals them out by gram. A loser tree that carries common-prefix lengths merges
the runs of a bucket: entries compare by those lengths alone and only look at bytes beyond the known prefix. In the
merged order, the prefix groups of both sides give every window of 200 bytes that starts twice.

Defined cases: null text is empty; texts under 200 bytes lose nothing; a text repeated (even under one id) matches its
copy; a text may match itself, overlaps included; an empty table gives an empty one; a length under two is an error.
Buckets are as many as the bytes of all texts ask for. Other columns are carried along,
except those that an output replaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX64, U, bounds, flat, lean, lean_batches, mix, pack, pack_sorted, parts, prefix_hash, slices, task_id, unpack, without

#: Bytes of an anchor's gram, at most.
GRAM = 64
#: Anchors of one packed batch; bytes of contexts that a task holds before it sends its sorted runs.
BATCH_ANCHORS, BATCH_CONTEXT = 1_000_000, 24 << 20


def _sliding(a: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over each window of w values (van Herk's two passes)."""
    n = len(a)
    p = np.full(-(-n // w) * w, fill, a.dtype)
    p[:n] = a
    p = p.reshape(-1, w)
    pre, suf = op.accumulate(p, 1).ravel(), op.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return op(suf[: n - w + 1], pre[w - 1 : n])


def gram_of(length: int) -> int:
    """Half the length for short strings, so that windows of several grams remain."""
    if length < 2:
        raise ValueError("repeats have two bytes at least")
    return min(GRAM, (length + 1) // 2)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions in buf of the grams that have the least hash of some window within one document."""
    w = length - gram + 1
    if len(buf) < length:
        return np.zeros(0, U), np.zeros(0, np.int64)
    c, down = prefix_hash(buf)
    g = mix((c[gram:] - c[:-gram]) * down[: len(buf) - gram + 1])
    del c
    across = np.zeros(len(buf) + 2, np.int32)
    ends = offs[1:]
    np.add.at(across, np.maximum(np.maximum(ends - gram + 1, 0), offs[:-1]), 1)
    np.add.at(across, ends, -1)
    bad = np.cumsum(across[: len(g)]) > 0
    g[bad] = MAX64
    least = _sliding(g, w, np.minimum, MAX64)
    pad = np.zeros(w - 1, U)
    most = _sliding(np.concatenate([pad, least, pad]), w, np.maximum, U(0))
    at = np.flatnonzero((most == g) & ~bad)
    doc = np.searchsorted(offs, at, "right") - 1
    at = at[(offs[1:] - offs[:-1])[doc] >= length]
    return g[at], at


def _requests(buckets: int, length: int, text_at: int):
    """Rows (key, batch, kind, blob): kind 0 asks a bucket about a batch's grams, kind 1 holds the batch's documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list = []
        d: list = []
        p: list = []
        k1: list = []
        k2: list = []
        held, serial, at = 0, 0, task_id() << 24
        low = bounds(buckets, 64)

        def flush() -> pa.RecordBatch:
            nonlocal held, serial
            batch = at + serial
            hs, ds, ps = np.concatenate(h), np.concatenate(d), np.concatenate(p)
            o = np.argsort(hs)
            hs, ds, ps = hs[o], ds[o], ps[o]
            new = np.r_[True, hs[1:] != hs[:-1]][: len(hs)]
            twice = (np.diff(np.r_[np.flatnonzero(new), len(hs)]) > 1)[np.cumsum(new) - 1] if len(hs) else new
            keys, kinds, blobs = [batch % buckets], [1], [pack(np.array(k1, np.int64), np.array(k2, np.int64), ds[twice], ps[twice])]
            hs, ds, ps = hs[new], ds[new], ps[new]
            cut = np.r_[np.searchsorted(hs, low), len(hs)]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                x, y = cut[b], cut[b + 1]
                keys.append(b)
                kinds.append(0)
                blobs.append(pack(np.diff(hs[x:y], prepend=U(0)), ds[x:y], ps[x:y]))
            for x in (h, d, p, k1, k2):
                x.clear()
            held, serial = 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([batch] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "batch", "kind", "blob"])

        for rb in batches:
            data, offs = flat(rb.column(text_at))
            a, b = (np.asarray(rb.column(rb.num_columns - c)) for c in (2, 1))
            for i, j in slices(offs, 1 << 20):
                o = offs[i : j + 1] - offs[i]
                g, where = anchors(data[offs[i] : offs[j]], o, length, gram_of(length))
                doc = np.searchsorted(o, where, "right") - 1
                used, idx = np.unique(doc, return_inverse=True)
                h.append(g)
                d.append((idx + len(k1)).astype(np.uint32))
                p.append((where - o[doc]).astype(np.uint32))
                k1.extend(a[i + used].tolist())
                k2.extend(b[i + used].tolist())
                held += len(g)
                if held >= BATCH_ANCHORS:
                    yield flush()
        if held:
            yield flush()

    return rows


def _again(table: pa.Table) -> pa.Table:
    """Of a bucket's grams, those that two batches have, sent back."""
    keys, kinds, blobs = [], [], []
    got = []
    for batch, kind, blob in zip(table["batch"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if kind:
            keys.append(batch)
            kinds.append(1)
            blobs.append(blob)
        else:
            h, d, p = unpack(blob)
            got.append((np.cumsum(h, dtype=U), d, p, np.full(len(h), batch, np.int64)))
    if got:
        h, d, p, w = (np.concatenate(x) for x in zip(*got, strict=True))
        o = np.argsort(h)
        h, d, p, w = h[o], d[o], p[o], w[o]
        new = np.r_[True, h[1:] != h[:-1]]
        keep = (np.diff(np.r_[np.flatnonzero(new), len(h)]) > 1)[np.cumsum(new) - 1]
        d, p, w = d[keep], p[keep], w[keep]
        o = np.argsort(w, kind="stable")
        d, p, w = d[o], p[o], w[o]
        cut = np.r_[np.flatnonzero(np.r_[True, w[1:] != w[:-1]]), len(w)] if len(w) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            keys.append(int(w[a]))
            kinds.append(0)
            blobs.append(pack(d[a:b], p[a:b]))
    return pa.table({"batch": pa.array(keys, pa.int64()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _by_document(table: pa.Table) -> pa.Table:
    """A batch's answers as rows (k1, k2, found): the sorted positions of the anchors to sort."""
    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    k1, k2, d, p = unpack(blobs[kinds.index(1)])
    got = [(d, p)] + [unpack(b) for b, kind in zip(blobs, kinds, strict=True) if not kind]
    key = np.unique(np.concatenate([x[0].astype(U) << U(32) | x[1].astype(U) for x in got]))
    doc = (key >> U(32)).astype(np.int64)
    cut = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
    first = doc[cut[:-1]]
    return pa.table({"k1": pa.array(k1[first]), "k2": pa.array(k2[first]), "found": pa.array([pack_sorted(key[a:b] & U(0xFFFFFFFF)) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix; the first at bytes are known to agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(run: list[bytes]) -> list[np.ndarray]:
    """A sorted run as common-prefix lengths with the string before, lengths of the rest, and the rests."""
    lcp = [0] * len(run)
    for i in range(1, len(run)):
        lcp[i] = common(run[i - 1], run[i])
    rest = [s[n:] for s, n in zip(run, lcp, strict=True)]
    return [np.array(lcp, np.uint16), np.array([len(r) for r in rest], np.uint16), np.frombuffer(b"".join(rest), np.uint8)]


def front_decode(lcp: np.ndarray, rest: np.ndarray, data: np.ndarray) -> Iterator[tuple[bytes, int]]:
    raw, at, last = data.tobytes(), 0, b""
    for n, m in zip(lcp.tolist(), rest.tolist(), strict=True):
        last = last[:n] + raw[at : at + m]
        at += m
        yield last, n


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, common prefix with the string before) in sorted order, by a loser tree over front-coded runs.

    Each stream holds its common prefix with the last output. The longer one is the smaller string, and the loser's
    length stays right; only at equal lengths are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    text = [h[0] if h else None for h in heads]
    lcp = [0 if h else -1 for h in heads]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's common prefix with the winner."""
        x, y = lcp[a], lcp[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = text[a], text[b]
        n = common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, tree[node] = play(build(2 * node), build(2 * node + 1))
        return w

    win = build(1) if k > 1 else 0
    while lcp[win] >= 0:
        yield win, text[win], lcp[win]
        nxt = next(runs[win], None)
        text[win], lcp[win] = nxt if nxt else (None, -1)
        node = (win + k) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


def _runs(buckets: int, length: int, text_at: int, found_at: int):
    """Rows (key, batch, kind, blob): a bucket's front-coded run of a batch's suffixes, or the batch's documents."""
    gram = gram_of(length)
    left = length - gram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        k1: list = []
        k2: list = []
        size, serial, at = 0, 0, task_id() << 24

        def flush() -> pa.RecordBatch:
            nonlocal size, serial
            batch = at + serial
            keys, kinds, blobs = [batch % buckets], [1], [pack(np.array(k1, np.int64), np.array(k2, np.int64))]
            by: dict = {}
            for entry in held.items():
                by.setdefault(zlib.crc32(entry[0][0][:gram]) % buckets, []).append(entry)
            for b, entries in by.items():
                entries.sort(key=lambda e: e[0])
                lefts = [e[0][1] for e in entries]
                places = [x for e in entries for x in e[1]]
                keys.append(b)
                kinds.append(0)
                blobs.append(pack(*front_code([e[0][0] for e in entries]), np.array([len(x) for x in lefts], np.uint16), np.frombuffer(b"".join(lefts), np.uint8), np.array([len(e[1]) // 2 for e in entries], np.uint32), np.array(places[::2], np.uint32), np.array(places[1::2], np.uint32)))
            held.clear()
            k1.clear()
            k2.clear()
            size, serial = 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([batch] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "batch", "kind", "blob"])

        for rb in batches:
            data, offs = flat(rb.column(text_at))
            raw = memoryview(data)
            found = rb.column(found_at)
            a, b = (rb.column(found_at + c).to_pylist() for c in (-2, -1))
            for r in range(rb.num_rows):
                text = bytes(raw[offs[r] : offs[r + 1]])
                doc = len(k1)
                k1.append(a[r])
                k2.append(b[r])
                for p in np.cumsum(unpack(found[r].as_py())[0], dtype=U).tolist():
                    entry = (text[p : p + length], text[max(0, p - left) : p][::-1])
                    if entry in held:
                        held[entry] += (doc, p)
                    else:
                        held[entry] = [doc, p]
                        size += len(entry[0]) + len(entry[1])
                if size >= BATCH_CONTEXT:
                    yield flush()
        if k1:
            yield flush()

    return rows


def _repeats(length: int):
    """Merges a bucket's runs; of every anchor, the span of its windows that start twice goes back to its batch."""

    def rows(table: pa.Table) -> pa.Table:
        keys, kinds, blobs = [], [], []
        runs, batches, lefts, counts, docs, places = [], [], [], [], [], []
        for batch, kind, blob in zip(table["batch"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if kind:
                keys.append(batch)
                kinds.append(1)
                blobs.append(blob)
                continue
            lcp, rest, data, left_len, left, count, doc, place = unpack(blob)
            runs.append(front_decode(lcp, rest, data))
            ends = np.cumsum(left_len, dtype=np.int64).tolist()
            raw = left.tobytes()
            lefts.append([raw[e - n : e] for e, n in zip(ends, left_len.tolist(), strict=True)])
            counts.append(count)
            docs.append(doc)
            places.append(place)
            batches.append(batch)
        if runs:
            seen = [0] * len(runs)
            source, lcps, lens, left_of = [], [], [], []
            for run, text, n in merge_runs(runs):
                source.append(run)
                lcps.append(n)
                lens.append(len(text))
                left_of.append(lefts[run][seen[run]])
                seen[run] += 1
            source, lcp, right = np.array(source), np.array(lcps), np.array(lens)
            o = np.argsort(source, kind="stable")  # of each run, its entries in order
            times = np.empty(len(source), np.int64)
            times[o] = np.concatenate(counts)
            low, high = _windows(lcp, right, left_of, times, length)
            each = np.concatenate(counts)
            low, high, where = np.repeat(low[o], each), np.repeat(high[o], each), np.repeat(np.array(batches)[source[o]], each)
            doc, place = np.concatenate(docs), np.concatenate(places).astype(np.int64)
            keep = high >= 0
            doc, start, end, where = doc[keep], (place - high)[keep].astype(np.uint32), (place - low + length)[keep].astype(np.uint32), where[keep]
            o = np.argsort(where, kind="stable")
            doc, start, end, where = doc[o], start[o], end[o], where[o]
            cut = np.r_[np.flatnonzero(np.r_[True, where[1:] != where[:-1]]), len(where)] if len(where) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                keys.append(int(where[a]))
                kinds.append(0)
                blobs.append(pack(doc[a:b], start[a:b], end[a:b]))
        return pa.table({"batch": pa.array(keys, pa.int64()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return rows


def _windows(lcp: np.ndarray, right: np.ndarray, lefts: list[bytes], times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of an anchor in its windows that start twice (-1: none).

    Entries are in the order of their suffixes; lcp has the common prefixes of neighbours. A window at offset o agrees
    in length - o bytes of the suffix and o bytes to the left, so it is a pair of prefix groups.
    """
    gram = gram_of(length)
    n, most = len(lcp), length - gram
    low, high = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    same = np.r_[lcp[1:] >= gram, False]
    use = np.flatnonzero(same | np.r_[False, same[:-1]] | (times > 1))
    # entries left out share less than a gram with any other, and no window needs less
    step = np.where(np.r_[True, np.diff(use) > 1], 0, lcp[use]).astype(np.int64) if len(use) else np.zeros(0, np.int64)
    wide = np.zeros((len(use), most), np.uint8)
    left = np.array([len(lefts[i]) for i in use], np.int64)
    for r, i in enumerate(use.tolist()):
        wide[r, : left[r]] = np.frombuffer(lefts[i], np.uint8)
    order = np.argsort(wide.view(f"S{most}").ravel(), kind="stable") if len(use) else use
    w = wide[order]
    diff = w[1:] != w[:-1]
    step_left = np.r_[0, np.where(diff.any(1), diff.argmax(1), most)].astype(np.int64) if len(use) else step
    r, t = right[use], times[use]
    for o in range(most + 1):
        fit = np.flatnonzero((left >= o) & (r >= length - o))
        if not len(fit):
            continue
        gl = np.empty(len(use), np.int64)
        gl[order] = np.cumsum(step_left < o)
        key = (np.cumsum(step < length - o) << 32 | gl)[fit]
        k = np.argsort(key)
        ks = key[k]
        new = np.r_[True, ks[1:] != ks[:-1]]
        group = np.cumsum(new) - 1
        hit = use[fit[k[np.bincount(group, t[fit[k]])[group] > 1]]]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def _spans(table: pa.Table) -> pa.Table:
    """A batch's spans, merged, as rows (k1, k2, spans)."""
    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    k1, k2 = unpack(blobs[kinds.index(1)])
    got = [unpack(b) for b, kind in zip(blobs, kinds, strict=True) if not kind]
    out: list = []
    which: list = []
    if got:
        d, s, e = (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True))
        o = np.lexsort((s, d))
        d, s, e = d[o], s[o], e[o]
        cut = np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            reach = np.maximum.accumulate(e[a:b])
            new = np.r_[True, s[a + 1 : b] > reach[:-1]]
            first = np.flatnonzero(new)
            out.append(pack(s[a:b][first], reach[np.r_[first[1:] - 1, b - a - 1]]))
            which.append(int(d[a]))
    return pa.table({"k1": pa.array(k1[which] if which else [], pa.int64()), "k2": pa.array(k2[which] if which else [], pa.int64()), "spans": pa.array(out, pa.binary())})


def _cut(text_at: int, names: list[str]):
    """Appends n_bytes, n_removed, n_spans, kept, kept_text (without halves of characters), kept_sha256 to each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = flat(rb.column(text_at))
            raw = memoryview(data)
            removed, spans, kept, sha = [], [], [], []
            for r, blob in enumerate(rb.column(len(names)).to_pylist()):
                text = raw[offs[r] : offs[r + 1]]
                if blob is None:
                    removed.append(0)
                    spans.append(0)
                    rest = bytes(text)
                else:
                    s, e = unpack(blob)
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                    rest = b"".join(bytes(text[a:b]) for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))
                kept.append(rest)
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(names))), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(sha, pa.string())], [*names, "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"])

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept (binary: the bytes left), kept_text and kept_sha256.

    Removed is each byte covered by a string of `length` bytes that starts anywhere else as well, judged on the input.
    """
    docs = without(docs, "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256")
    names = docs.columns
    text_at = [n.lower() for n in names].index(text_col.lower())
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(*(text.alias(c) if i == text_at else docs[c] for i, c in enumerate(names)), F.coalesce(docs[id_col].cast("long"), F.lit(-1)).alias("_weft_k1"), F.xxhash64(text, docs[id_col].isNull()).alias("_weft_k2"))
    buckets = parts(docs, text_col)
    plan = "key int, batch long, kind int, blob binary"
    back = "batch long, kind int, blob binary"
    found = (
        source.mapInArrow(lean_batches(_requests(buckets, length, text_at)), plan)
        .repartition(buckets, "key").groupBy("key").applyInArrow(lean(_again), back)
        .groupBy("batch").applyInArrow(lean(_by_document), "k1 long, k2 long, found binary")
        .groupBy("k1", "k2").agg(F.first("found").alias("_weft_found"))
        .withColumnsRenamed({"k1": "_weft_f1", "k2": "_weft_f2"})
    )
    spans = (
        source.join(found, (F.col("_weft_k1") == F.col("_weft_f1")) & (F.col("_weft_k2") == F.col("_weft_f2")))
        .select(*source.columns, "_weft_found")
        .mapInArrow(lean_batches(_runs(buckets, length, text_at, len(names) + 2)), plan)
        .repartition(buckets, "key").groupBy("key").applyInArrow(lean(_repeats(length)), back)
        .groupBy("batch").applyInArrow(lean(_spans), "k1 long, k2 long, spans binary")
        .groupBy("k1", "k2").agg(F.first("spans").alias("_weft_spans"))
        .withColumnsRenamed({"k1": "_weft_s1", "k2": "_weft_s2"})
    )
    joined = source.join(spans, (F.col("_weft_k1") == F.col("_weft_s1")) & (F.col("_weft_k2") == F.col("_weft_s2")), "left").select(*names, "_weft_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    return joined.mapInArrow(lean_batches(_cut(text_at, names)), f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string")

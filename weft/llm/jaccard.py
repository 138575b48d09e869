"""N-gram Jaccard join by a token-group matrix.

Shingles are counted once over all documents; a document keeps the shingles that some other document has as well.
The rarest ones form its prefix: two documents with similarity >= t have COMMON shingles of their prefixes in common (or
as many as they must share at all). Documents are partitioned into groups of similar ones (by their smallest shared
shingle); the matrix holds, for each group, the union of its members' prefix shingles with the span of set sizes of
their holders. A query document bounds its overlap with a group by the shingles of that union it has, opens only groups
where they are enough, and is checked there by exact overlap counts.

A shingle that many documents of a batch have goes to its bucket once, with their number. Buckets are as many as the
bytes of all texts ask for; a group is opened in blocks of members and of queries.

Defined cases: a null or blank text has the empty set and is linked with nothing; a text of fewer than five words has
one shingle, its whole sequence; equal sets collapse before any comparison; repeated ids keep a row each; a null id
keeps its row and never names a component that has another id; an empty table gives an empty one. Columns beyond the
id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_TABLE, GOLD, MIX1, U, bounds, flat, lean, lean_batches, materialize, mix, pack, pack_sorted, parts, prefix_hash, slices, task_id, unpack, unpack_sorted
from .components import connected_components

#: A-Z hash as a-z.
LOWER = BYTE_TABLE.copy()
LOWER[65:91] = BYTE_TABLE[97:123]
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
#: Shingles of one packed batch, and documents of one (their index takes 16 bits).
BATCH_SHINGLES, BATCH_DOCS = 2_000_000, 60_000
#: Documents of a batch that make a shingle a frequent one there, and the index that stands for all of them.
MANY, ALL = 512, 0xFFFF
#: Prefix shingles that linked documents have in common.
COMMON = 4
#: Members of a group, and queries, that one task opens at once.
BLOCK, ASKS = 1024, 2048


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf; first word of each document (offs relative to buf)."""
    is_word = WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.r_[False, is_word[:-1]] & ~edge[:-1] if len(buf) else is_word
    after = np.r_[is_word[1:], False] & ~edge[1:] if len(buf) else is_word
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each document."""
    starts, ends, first = word_spans(buf, offs)
    if len(starts):
        c, down = prefix_hash(buf, LOWER)
        words = mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U) * MIX1)
        n = len(words) - k + 1
        if n > 0:
            grams = words[:n].copy()
            for j in range(1, k):
                grams = grams * GOLD + words[j : j + n]
            grams = mix(grams)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = np.full(1, b - a, U)
            for j in range(a, b):
                whole = whole * GOLD + words[j : j + 1]
            yield mix(whole ^ MIX1)
        else:
            yield np.zeros(0, U)


def _shingles(buckets: int, k: int):
    """Rows (key, batch, kind, blob): kind 0 is a bucket's part of a batch's shingles, kind 1 the batch's documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        null: list = []
        mark: list = []
        size: list = []
        sid: list = []
        grams: list = []
        seen: set = set()
        held, serial, at = 0, 0, task_id() << 24
        low = bounds(buckets, 48) << U(16)

        def flush() -> pa.RecordBatch:
            nonlocal held, serial
            batch = at + serial
            all_ = np.concatenate(grams) if grams else np.zeros(0, U)
            grams.clear()
            all_.sort()
            low_of = lambda g: np.searchsorted(all_, g << U(16))
            often = np.unique(all_[MANY - 1 :][all_[MANY - 1 :] >> U(16) == all_[: max(0, len(all_) - MANY + 1)] >> U(16)] >> U(16))
            weight = low_of(often + U(1)) - low_of(often)
            frequent = np.zeros(0, U)
            if len(often):
                rest = np.ones(len(all_), bool)
                for x, n in zip(low_of(often).tolist(), weight.tolist(), strict=True):
                    rest[x : x + n] = False
                frequent, all_ = all_[~rest], np.r_[all_[rest], often << U(16) | U(ALL)]
                all_.sort()
            cuts = np.r_[np.searchsorted(all_, low), len(all_)]
            of = np.searchsorted(low, often << U(16), "right") - 1  # a frequent one's bucket
            keys, kinds, blobs = [batch % buckets], [1], [pack(np.array(ids, np.int64), np.array(null, np.uint8), np.array(mark, np.int64), np.array(size, np.int64), np.frombuffer(b"".join(sid), np.uint8), np.diff(frequent, prepend=U(0)))]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = all_[cuts[b] : cuts[b + 1]]
                keys.append(b)
                kinds.append(0)
                blobs.append(pack(np.diff(part >> U(16), prepend=U(0)), (part & U(0xFFFF)).astype(np.uint16), weight[of == b]))
            for x in (ids, null, mark, size, sid, grams, seen):
                x.clear()
            held, serial = 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([batch] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "batch", "kind", "blob"])

        for rb in batches:
            doc = rb.column(0)
            data, offs = flat(rb.column(1))
            nulls = np.asarray(doc.is_null())
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
            marks = rb.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(offs, 1 << 20):
                for r, s in enumerate(shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k), i):
                    name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if len(s) and name not in seen:
                        seen.add(name)
                        grams.append(np.unique(s >> U(16)) << U(16) | U(len(ids)))
                        held += len(s)
                    ids.append(doc[r])
                    null.append(nulls[r])
                    mark.append(marks[r])
                    size.append(len(s))
                    sid.append(name)
                    if held >= BATCH_SHINGLES or len(ids) >= BATCH_DOCS:
                        yield flush()
        if ids:
            yield flush()

    return rows


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket, the shingles that two documents have, sent back to their batches with the number of documents."""
    keys, kinds, blobs = [], [], []
    grams, where, index, weights = [], [], [], []
    for batch, kind, blob in zip(table["batch"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if kind:
            keys.append(batch)
            kinds.append(1)
            blobs.append(blob)
        else:
            d, i, frequent = unpack(blob)
            grams.append(np.cumsum(d, dtype=U))
            index.append(i)
            weight = np.ones(len(i), np.int64)
            weight[i == ALL] = frequent
            weights.append(weight)
            where.append(np.full(len(i), batch, np.int64))
    if grams:
        g, w, i, each = np.concatenate(grams), np.concatenate(where), np.concatenate(index), np.concatenate(weights)
        o = np.argsort(g)
        g, w, i = g[o], w[o], i[o]
        new = np.r_[True, g[1:] != g[:-1]]
        df = np.add.reduceat(each[o], np.flatnonzero(new))[np.cumsum(new) - 1]
        keep = df > 1
        g, w, i, df = g[keep], w[keep], i[keep], np.minimum(df[keep], 65535).astype(np.uint16)
        o = np.argsort(w, kind="stable")
        g, w, i, df = g[o], w[o], i[o], df[o]
        cut = np.r_[np.flatnonzero(np.r_[True, w[1:] != w[:-1]]), len(w)] if len(w) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            keys.append(int(w[a]))
            kinds.append(0)
            blobs.append(pack(np.diff(g[a:b], prepend=U(0)), i[a:b], df[a:b]))
    return pa.table({"batch": pa.array(keys, pa.int64()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def least_overlap(n, percent: int):
    """Shingles that a partner shares at least with a set of n: the ceiling of percent * n / 100."""
    return -(-percent * n // 100)


def _documents(percent: int):
    """Rows (doc_id, mark, n, sid, shared, prefix, grp) of a batch; the last three only where a link is possible."""

    def rows(table: pa.Table) -> pa.Table:
        kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
        ids, null, mark, size, sid, frequent = unpack(blobs[kinds.index(1)])
        frequent = np.cumsum(frequent, dtype=U)
        sids = [sid[16 * r : 16 * r + 16].tobytes() if n else None for r, n in enumerate(size)]
        shared: list = [None] * len(ids)
        prefix: list = [None] * len(ids)
        group: list = [None] * len(ids)
        got = [unpack(b) for b, kind in zip(blobs, kinds, strict=True) if not kind]
        if got:
            g, i, df = np.concatenate([np.cumsum(x[0], dtype=U) for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
            if len(frequent):  # every holder of a frequent shingle
                whole = frequent >> U(16)
                lot = np.flatnonzero(i == ALL)
                lo, hi = np.searchsorted(whole, g[lot], "left"), np.searchsorted(whole, g[lot], "right")
                at = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum())
                rest = i != ALL
                g, df = np.r_[g[rest], whole[at]], np.r_[df[rest], np.repeat(df[lot], hi - lo)]
                i = np.r_[i[rest], (frequent[at] & U(0xFFFF)).astype(np.uint16)]
            o = np.lexsort((g, df, i))
            g, i = g[o], i[o]
            cut = np.r_[np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                n = int(size[r := i[a]])
                least = least_overlap(n, percent)
                if b - a >= least:
                    own = np.sort(g[a:b])
                    shared[r], prefix[r], group[r] = pack_sorted(own), pack_sorted(np.sort(g[a : min(b, b - least + COMMON)])), int(own[0])
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "mark": pa.array(mark, pa.int64()), "n": pa.array(size, pa.int64()), "sid": pa.array(sids, pa.binary()), "shared": pa.array(shared, pa.binary()), "prefix": pa.array(prefix, pa.binary()), "grp": pa.array(group, pa.int64())})

    return rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for sid, n, grp, blob in zip(*(rb.column(c).to_pylist() for c in range(4)), strict=True):
            tok = unpack_sorted(blob).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([sid] * len(tok), pa.binary()), pa.array(np.full(len(tok), n)), pa.array(np.full(len(tok), grp)), pa.array(tok)], ["sid", "n", "grp", "tok"])


def _open(percent: int, thin: bool):
    """Links between the queries and the members of one block of a group; thin: of links within a component, a tree."""

    def rows(table: pa.Table) -> pa.Table:
        name, n, blob, member = (table[c].to_pylist() for c in ("sid", "n", "shared", "member"))
        sets = {s: unpack_sorted(b) for s, b in zip(name, blob, strict=True)}
        size = dict(zip(name, n, strict=True))
        members = sorted({s for s, m in zip(name, member, strict=True) if m}, key=lambda s: (size[s], s))
        queries = sorted({s for s, m in zip(name, member, strict=True) if not m}, key=lambda s: (size[s], s))
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if members:
            toks = np.concatenate([sets[m] for m in members])
            whose = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
            o = np.argsort(toks, kind="stable")
            toks, whose = toks[o], whose[o]
            sizes = np.array([size[m] for m in members])
            union = toks[np.r_[True, toks[1:] != toks[:-1]]]
            for i, q in enumerate(queries):
                s, nq = sets[q], size[q]
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if (union[at] == s).sum() < least_overlap(nq, percent):
                    continue
                lo, hi = np.searchsorted(toks, s, "left"), np.searchsorted(toks, s, "right")
                count = hi - lo
                flat_at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                both = np.bincount(whose[flat_at], minlength=len(members))
                hits = np.flatnonzero(100 * both >= percent * (nq + sizes - both))
                if thin:
                    kept = []
                    for m in hits:
                        if (x := members[m]) != q and top(x) != top(q):
                            root[top(x)] = top(q)
                            kept.append(m)
                    hits = np.array(kept, np.int64)
                left.append(np.full(len(hits), i))
                right.append(hits)
        return pa.table({"a": pa.array(queries, pa.binary()).take(pa.array(np.concatenate(left))), "b": pa.array(members, pa.binary()).take(pa.array(np.concatenate(right)))})

    return rows


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, mark: Column | None = None, thin: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents(doc_id, mark, n, sid), representatives(sid, rep, no), links(a, b) between representatives' numbers).

    sid names the shingle set (null: empty); rep is its least id, and no numbers the sets in the order of rep (null last).
    mark, a long, tells rows of one id apart. Every pair of sets that are similar enough is there once, a < b; thin: links
    within a component only as a forest for each group opened, which is enough for components.
    """
    buckets = parts(docs, text_col)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    rows = (
        source.mapInArrow(lean_batches(_shingles(buckets, k)), "key int, batch long, kind int, blob binary")
        .repartition(buckets, "key").groupBy("key").applyInArrow(lean(_shared), "batch long, kind int, blob binary")
        .groupBy("batch").applyInArrow(lean(_documents(percent)), "doc_id long, mark long, n long, sid binary, shared binary, prefix binary, grp long")
    )
    table = materialize(rows, "shingles")
    reps = table.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep")).orderBy(F.asc_nulls_last("rep"), "sid")
    reps = materialize(reps.select("sid", "rep", F.monotonically_increasing_id().alias("no")), "representatives")
    sets = materialize(table.where("shared is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix")), "sets")
    posts = sets.select("sid", "n", "grp", "prefix").mapInArrow(_postings, "sid binary, n long, grp long, tok long")
    matrix = posts.groupBy("tok", F.col("grp").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"))
    bound = (
        posts.join(matrix, "tok")
        .where(f"g >= grp and (g <> grp or members > 1) and 100 * most >= {percent} * n and 100 * n >= {percent} * least")
        .groupBy("sid", "n", "g").agg(F.count("*").alias("overlap"))
        .where(f"overlap >= least({COMMON}, ceil({percent} * n / 100))").select("sid", "g")
    )
    bound = materialize(bound, "bound")
    size = sets.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    size = materialize(bound.groupBy("g").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("asks")).join(size, "g"), "groups")
    place = lambda n: F.pmod(F.hash("sid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    opened = bound.join(size, "g").select("sid", "g", every("blocks").alias("block"), place("asks").alias("ask"))
    queries = opened.join(sets.select("sid", "n", "shared"), "sid").select("g", "block", "ask", "sid", "n", "shared", F.lit(False).alias("member"))
    members = sets.withColumnRenamed("grp", "g").join(size, "g").select("g", place("blocks").alias("block"), every("asks").alias("ask"), "sid", "n", "shared", F.lit(True).alias("member"))
    links = queries.union(members).groupBy("g", "block", "ask").applyInArrow(_open(percent, thin), "a binary, b binary")
    named = links.join(reps.select(F.col("sid").alias("a"), F.col("no").alias("na")), "a").join(reps.select(F.col("sid").alias("b"), F.col("no").alias("nb")), "b")
    pairs = named.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    return table.select("doc_id", "mark", "n", "sid"), reps, pairs if thin else pairs.distinct()


def jaccard_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents(doc_id, mark, n, sid), sets(sid, rep, no, component)): component is the smallest number reachable by links."""
    table, reps, links = jaccard_links(docs, id_col, text_col, k, percent, mark, thin=True)
    comps = connected_components(links)
    return table, materialize(reps.join(comps, reps["no"] == comps["node"], "left").select("sid", "rep", "no", F.coalesce("component", "no").alias("component")), "named")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id reachable by links, its own included."""
    table, sets = jaccard_sets(docs, id_col, text_col, k, percent)
    whole = sets.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = sets.join(whole, "component").select("sid", "component_id")
    own = table.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return table.where("sid is not null").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(own)

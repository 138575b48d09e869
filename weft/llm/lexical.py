"""Ranked lexical search: document-sharded postings with integer impacts, scored a term at a time into dense arrays.

Two passes over the texts: the first counts documents and terms (in the JVM), so that the second can write each shard's
postings (compressed rows: a sorted vocabulary, starts, documents, and impacts that already hold the length of the
document). A query block is sent to all shards: document frequencies are added up over shards, then each shard adds
weight times impact into one array a query, takes its best by a partition that keeps ties, and tasks, then salted groups,
then queries merge these lists.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. The queries
reach the executors in blocks of bounded size, each a pass over the index.

Defined cases: null or termless texts are no documents and no results; a query that is null or has no term has no
result; each row of queries is a query of its own, whatever its id; rows of documents, repeated or not, are documents
of their own; equal scores go by id, a null id last; without documents or queries there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean_batches, materialize, pack, unpack

#: What is no part of a term, as a pattern of the JVM, and the same as a table of bytes (terms lower-cased).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Bytes of text of one shard, and of queries of one block.
SHARD, BLOCK = 8 << 20, 1 << 20
#: Lists of one query that a first merge takes at most.
FAN_IN = 64


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def spread(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's length against the average one: 100 for that."""
    return 50 + (50 * length * n) // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences are worth in a document of spread m, out of a million; 64-bit integers."""
    return (1000000000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Index:
    """Written shards, and how many documents and terms there are."""

    shards: DataFrame
    documents: int
    terms: int
    id_kind: str


class Vocabulary:
    """One shard's terms, in order, and where the postings of each start."""

    def __init__(self, blob: bytes) -> None:
        sizes, letters, steps = unpack(blob)
        self.ends, self.letters = np.cumsum(sizes, dtype=np.int64).tolist(), letters.tobytes()
        self.starts = np.r_[0, np.cumsum(steps, dtype=np.int64)]

    def word(self, i: int) -> bytes:
        return self.letters[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """Number of each of the sorted wanted words in this shard, or -1: one binary search each, from the last one on."""
        out, lo, n = np.full(len(wanted), -1, np.int64), 0, len(self.ends)
        for k, w in enumerate(wanted):
            hi = n
            while lo < hi:
                mid = (lo + hi) // 2
                if self.word(mid) < w:
                    lo = mid + 1
                else:
                    hi = mid
            if lo < n and self.word(lo) == w:
                out[k] = lo
        return out


def _shard(words: list[list[bytes]], n: int, total: int) -> tuple[bytes, bytes]:
    code: dict[bytes, int] = {}
    length = np.array([len(w) for w in words], np.int64)
    at = np.fromiter((code.setdefault(w, len(code)) for doc in words for w in doc), np.int64, int(length.sum()))
    names = sorted(code)
    place = np.empty(len(names), np.int64)
    place[[code[w] for w in names]] = np.arange(len(names))
    keys, tf = np.unique(place[at] * len(words) + np.repeat(np.arange(len(words)), length), return_counts=True)
    term, doc = np.divmod(keys, len(words))
    held = impact(tf, spread(length, n, total)[doc])
    vocabulary = pack(np.array([len(w) for w in names], np.int32), np.frombuffer(b"".join(names), np.uint8), np.bincount(term, minlength=len(names)).astype(np.int32))
    return vocabulary, pack(doc.astype(np.int32), held.astype(np.int32))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of docs that have a term."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    per = rows.select(F.regexp_count("text", F.lit(TERM)).alias("n")).where("n > 0")
    n, total = per.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = rows.dtypes[0][1]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0

        def out() -> pa.RecordBatch:
            vocabulary, blob = _shard(words, n, total)
            made = pa.concat_arrays(ids)
            one = pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made)
            return pa.RecordBatch.from_arrays([one, pa.array([vocabulary], pa.binary()), pa.array([blob], pa.binary())], ["ids", "vocabulary", "blob"])

        for rb in batches:
            for i, t in enumerate(rb.column(1)):
                found = terms(t.as_py())
                if not found:
                    continue
                ids.append(rb.column(0).slice(i, 1))
                words.append(found)
                held += sum(map(len, found)) + len(found)
                if held >= SHARD:
                    yield out()
                    ids, words, held = [], [], 0
        if words:
            yield out()

    made = materialize(rows.mapInArrow(lean_batches(shards), f"ids array<{kind}>, vocabulary binary, blob binary"), "postings")
    return Index(made, n, total, kind)


@dataclass
class Block:
    """Some queries: their rows' numbers, all their terms in order, and each query's terms as numbers among these."""

    numbers: list[int]
    words: list[bytes]
    asked: list[np.ndarray]


def blocks(queries: DataFrame, limit: int = BLOCK) -> Iterator[Block]:
    """queries(number, text) in blocks, a partition of bounded size at a time."""
    numbers, lots, held = [], [], 0

    def out() -> Block:
        words = sorted(set().union(*lots))
        place = {w: i for i, w in enumerate(words)}
        return Block(numbers, words, [np.array(sorted(place[w] for w in lot), np.int64) for lot in lots])

    for row in queries.toLocalIterator():
        lot = set(terms(row["text"]))
        if lot:
            numbers.append(row["number"])
            lots.append(lot)
            held += sum(map(len, lot)) + 50 * len(lot)
            if held >= limit:
                yield out()
                numbers, lots, held = [], [], 0
    if lots:
        yield out()


def frequencies(index: Index, words: list[bytes]) -> np.ndarray:
    """How many documents hold each of the sorted words."""
    sent = index.shards.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for rb in batches:
            for blob in rb.column(0):
                shard = Vocabulary(blob.as_py())
                at = shard.find(sent.value)
                some = at >= 0
                n[some] += np.diff(shard.starts)[at[some]]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["term", "n"])

    got = index.shards.select("vocabulary").mapInArrow(lean_batches(rows), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def best(score: np.ndarray, k: int, order: np.ndarray) -> np.ndarray:
    """Positions of the k highest scores above 0, ties by order (a rank of ids), none lost at the edge."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        edge = score[some][np.argpartition(-score[some], k - 1)[k - 1]]
        above, level = some[score[some] > edge], some[score[some] == edge]
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(order[level], need - 1)[:need]]
        some = np.r_[above, level]
    return some[np.lexsort((order[some], -score[some]))]


def _scored(index: Index, block: Block, k: int) -> DataFrame:
    """(number, id, score): the best k of each query in each task's shards."""
    n = index.documents
    sent = index.shards.sparkSession.sparkContext.broadcast((block, weight(n, frequencies(index, block.words))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = sent.value
        held: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for rb in batches:
            for ids, vocabulary, blob in zip(rb.column(0), rb.column(1), rb.column(2), strict=True):
                shard, ids = Vocabulary(vocabulary.as_py()), ids.values
                docs, impacts = unpack(blob.as_py())
                order, at = ranks(ids), shard.find(asked.words)
                for q, own in enumerate(asked.asked):
                    score = np.zeros(len(ids), np.int64)
                    for t in own[at[own] >= 0].tolist():
                        a, b = shard.starts[at[t]], shard.starts[at[t] + 1]
                        score[docs[a:b]] += w[t] * impacts[a:b]
                    top = best(score, k, order)
                    if not len(top):
                        continue
                    score, found = score[top], ids.take(pa.array(top))
                    if q in held:
                        score, found = np.r_[held[q][0], score], pa.concat_arrays([held[q][1], found])
                        top = best(score, k, ranks(found))
                        score, found = score[top], found.take(pa.array(top))
                    held[q] = score, found
        for q, (score, found) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([asked.numbers[q]] * len(score), pa.int64()), found, pa.array(score, pa.int64())], ["number", "id", "score"])

    return index.shards.mapInArrow(lean_batches(rows), f"number long, id {index.id_kind}, score long")


def ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id in ascending order, nulls last."""
    out = np.empty(len(ids), np.int64)
    out[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return out


def _merged(found: DataFrame, k: int, tasks: int) -> DataFrame:
    """Lists of all tasks merged: in salted groups of a bounded number of lists, until one step can end it."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        found = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(tasks)))
        w = Window.partitionBy("number", "_salt").orderBy(*order)
        found = found.withColumn("_r", F.row_number().over(w)).where(f"_r <= {k}").drop("_r", "_salt")
    w = Window.partitionBy("number").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def search(index: Index, queries: DataFrame, k: int = 50, query_id: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_col, score) of each query's k best documents, in blocks of queries."""
    named = queries.select(queries[query_id].alias("query"), queries[text_col].cast("string").alias("text")).withColumn("number", F.monotonically_increasing_id())
    named = materialize(named, "queries")
    tasks = index.shards.rdd.getNumPartitions()
    out = None
    for block in blocks(named):
        found = materialize(_merged(_scored(index, block, k), k, tasks), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = index.shards.sparkSession.createDataFrame([], f"number long, id {index.id_kind}, score long, rank int")
    return out.join(named.select("number", "query"), "number").select(F.col("query").alias(query_id), "rank", F.col("id").alias(doc_col), "score")

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairwise interactions of low rank in
linear time. Words are counts of 2**BITS hashed buckets, scaled to length one; statistics of structure and the recorded
number of characters enter as standardised values and as quantile bins.

Training takes the SAMPLE labelled rows of least hash (in a total order of id, text and n_chars), on the driver, whole
texts. Labels, language, source and id are never inputs of a score.

Defined cases: null text is empty and gets a score from its statistics; a null n_chars counts as the text's own length;
of an id with several labels the mean decides (0.5 up is 1); null labels do not teach; without both labels every score
is the share of label 1 (0.5 without labels); repeated rows are independent, and each of them may teach; an empty table
gives an empty one; other columns are carried along except those that an output replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, crc_mod, flat, mix, prefix_hash, slices, without
from .jaccard import LOWER, word_spans

#: Bound of the training sample, hash bits of words, rank of the interactions, bins of a statistic.
SAMPLE, BITS, RANK, BINS = 3000, 14, 4, 8


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, LINE = _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b"\n")
PUNCT = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
PLAIN = _class(b".,;'-")
WIDE = _class(bytes(range(128, 256)))


def describe(buf: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics by document, document, bucket and value of each word entry)."""
    n = np.diff(offs).astype(float)
    starts, ends, first = word_spans(buf, offs)
    words = np.diff(first).astype(float)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=c[1:])
        return c

    def share(flags: np.ndarray) -> np.ndarray:
        c = total(flags)
        return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(n, 1)

    c, down = prefix_hash(buf, LOWER)
    h = mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U))
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    bucket = (h >> U(64 - BITS)).astype(np.int64)
    key, count = np.unique(doc << BITS | bucket, return_counts=True)
    d, b = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(count)
    value /= np.sqrt(np.bincount(d, value**2, len(n)))[d] if len(d) else 1
    again = total(np.r_[False, h[1:] == h[:-1]][: len(h)])
    twice = np.r_[False, buf[1:] == buf[:-1]][: len(buf)]
    odd = PUNCT[buf] & ~PLAIN[buf]
    tail = total(odd[ends - 1]) if len(ends) else np.zeros(1)
    per_word = lambda c: (c[first[1:]] - c[first[:-1]]) / np.maximum(words, 1)
    stats = np.stack([
        np.log1p(n), np.log1p(words), n / np.maximum(words, 1), share(UPPER[buf]), share(DIGIT[buf]), share(PUNCT[buf]),
        share(odd), share(WIDE[buf]), share(LINE[buf]), per_word(again), np.bincount(d, minlength=len(n)) / np.maximum(words, 1),
        share(twice & PUNCT[buf]), per_word(tail), np.log1p(n_chars),
    ], 1)
    return stats, d, b, value


def spread(stats: np.ndarray, scale: dict) -> np.ndarray:
    """Standardised statistics and one-hot quantile bins."""
    z = np.clip((stats - scale["mean"]) / scale["std"], -4, 4) / 4
    hot = [(np.searchsorted(e, stats[:, i], "right")[:, None] == np.arange(BINS)).astype(float) for i, e in enumerate(scale["edges"])]
    return np.concatenate([z, *hot], 1)


def margin(model: dict, dense: np.ndarray, d: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value by document, and its factor sums; entries are in document order."""
    n = len(dense)
    w, v, dw, dv = model["w"], model["v"], model["dw"], model["dv"]
    add = lambda e: np.bincount(d, e, n)
    sums = np.stack([add(v[b, f] * x) for f in range(RANK)], 1) + dense @ dv
    squares = np.stack([add((v[b, f] * x) ** 2) for f in range(RANK)], 1) + dense**2 @ dv**2
    return model["w0"] + add(w[b] * x) + dense @ dw + 0.5 * (sums**2 - squares).sum(1), sums


def train(texts: list[bytes], n_chars: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.05, l2: float = 2e-4, seed: int = 3) -> dict:
    offs = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    got = []
    for i, j in slices(offs, 1 << 20):  # so that flat arrays stay small
        stats, d, b, x = describe(np.frombuffer(b"".join(texts[i:j]), np.uint8), offs[i : j + 1] - offs[i], n_chars[i:j])
        got.append((stats, (d + i).astype(np.int32), b.astype(np.int32), x))
    stats, d, b, x = (np.concatenate(c) for c in zip(*got, strict=True))
    scale = {"mean": stats.mean(0), "std": stats.std(0) + 1e-9, "edges": [np.quantile(c, np.arange(1, BINS) / BINS) for c in stats.T]}
    dense = spread(stats, scale)
    rng = np.random.default_rng(seed)
    m = {"w0": np.zeros(1), "w": np.zeros(1 << BITS), "v": rng.normal(0, 0.05, (1 << BITS, RANK)), "dw": np.zeros(dense.shape[1]), "dv": rng.normal(0, 0.05, (dense.shape[1], RANK))}
    first = {k: np.zeros_like(p) for k, p in m.items()}
    second = {k: np.zeros_like(p) for k, p in m.items()}
    for t in range(1, rounds + 1):
        z, sums = margin(m, dense, d, b, x)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        ge = g[d] * x
        grad = {"w0": g.sum(keepdims=True), "w": np.bincount(b, ge, 1 << BITS), "dw": dense.T @ g}
        grad["v"] = np.stack([np.bincount(b, ge * (sums[d, f] - m["v"][b, f] * x), 1 << BITS) for f in range(RANK)], 1)
        grad["dv"] = dense.T @ (g[:, None] * sums) - m["dv"] * ((dense**2).T @ g)[:, None]
        for k, p in m.items():
            q = grad[k] + l2 * p * (k != "w0") / 10
            first[k] = 0.9 * first[k] + 0.1 * q
            second[k] = 0.999 * second[k] + 0.001 * q * q
            m[k] = p - rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m | {"scale": scale}


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars") -> dict:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chars = F.coalesce((F.col(chars_col) if chars_col else F.lit(None)).cast("long"), F.lit(-1))
    own = [F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("t"), chars.alias("c")]
    least = docs.select(*own).join(known, "i").orderBy(F.xxhash64("i"), "i", "t", "c").limit(SAMPLE)
    chosen, label = {}, {}
    for r in least.collect():
        chosen[r["i"], r["t"], r["c"]] = chosen.get((r["i"], r["t"], r["c"]), 0) + 1
        label[r["i"]] = r["y"]
    if not chosen:
        return {"share": 0.5}
    # the chosen rows' texts, one for rows that are the same in all three
    text = docs.where(F.col(id_col).isin(sorted(label))).groupBy(*own).agg(F.first(text_col).alias("text"))
    wanted = docs.sparkSession.createDataFrame(list(chosen), docs.select(*own).schema)
    rows = sorted((r["i"], r["t"], r["c"], r["text"] or "") for r in text.join(F.broadcast(wanted), ["i", "t", "c"], "left_semi").collect())
    rows = [r for r in rows for _ in range(chosen[r[:3]])]
    y = np.array([label[r[0]] for r in rows], float)
    if len(set(y)) < 2:
        return {"share": float(y.mean())}
    return train([r[3].encode() for r in rows], np.array([len(r[3]) if r[2] < 0 else r[2] for r in rows], float), y)


def score_texts(docs: DataFrame, model: dict, text_col: str = "text", chars_col: str | None = "n_chars", out: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    docs = without(docs, out)
    names = docs.columns
    lower = [n.lower() for n in names]
    at = lower.index(text_col.lower())
    chars_at = lower.index(chars_col.lower()) if chars_col else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for rb in batches:
            data, offs = flat(rb.column(at).cast(pa.string()))
            scores = [np.zeros(0)]
            chars = np.full(rb.num_rows, np.nan)
            if chars_at is not None:
                chars = rb.column(chars_at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for i, j in slices(offs, 1 << 20):
                if "share" in model:
                    scores.append(np.full(j - i, model["share"]))
                    continue
                buf, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                follow = np.zeros(len(buf) + 1)
                np.cumsum((buf & 0xC0) != 0x80, out=follow[1:])
                own = follow[o[1:]] - follow[o[:-1]]
                c = np.where(np.isnan(chars[i:j]) | (chars[i:j] < 0), own, chars[i:j])
                stats, d, b, x = describe(buf, o, c)
                scores.append(1 / (1 + np.exp(-np.clip(margin(model, spread(stats, model["scale"]), d, b, x)[0], -30, 30))))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(np.concatenate(scores), pa.float64())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{fields}, `{out}` double")


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted): learns only from rows whose crc32(id as text) mod 4 is not 2."""
    fold = F.expr(crc_mod(f"`{id_col}`", 4))
    model = train_on(docs, labels.where(fold != 2), id_col)
    scored = score_texts(docs.select(id_col, "text", "n_chars"), model)
    return scored.select(id_col, F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

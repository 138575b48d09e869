"""Language ID by a linear-chain conditional random field over words.

A word's score in each language adds weights of its affixes, its byte trigrams and its lexicon entry (the word's hash);
learned transitions tie neighbours together, so that each word of code-switched text gets its own posterior by
forward-backward. A document's language is the one with the largest mean posterior over its words.

A document is one chain, however long. Messages run through it in segments of SEGMENT words: each segment's transfer
matrix carries what comes before and after it, so segments are worked on side by side and the result is that of one
pass over the whole chain.

Training takes whole labelled documents from a bounded sample (PER_LANGUAGE rows a language, MAX_ROWS in all: the rows
of least hash, in a total order) on the driver; part of the chains are spliced from two languages. Scoring is vectorised
over flat bytes, without a Python step per word.

Defined cases: null text, or text without a letter, is `und` with score 0; without any labelled row everything is
`und`; repeated rows are independent, and each of them may teach; other columns are ignored or, in `identify`, carried
along except those that an output replaces; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_TABLE, U, crc_mod, flat, lean_batches, mix, prefix_hash, slices, without

#: Words of one segment; a number for speed, which does not change results.
SEGMENT = 64
#: Bounds of the training sample, in rows.
PER_LANGUAGE, MAX_ROWS = 150, 3000
BITS = 15
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, and the first word of each document."""
    is_word = LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.r_[False, is_word[:-1]][: len(buf)] & ~edge[:-1]
    after = np.r_[is_word[1:], False][: len(buf)] & ~edge[1:]
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers: of each word (affixes of one to three bytes and the lexicon entry), and of each byte (its trigram)."""
    low = LOWER[buf]
    pad = np.r_[low, np.zeros(3, np.uint8)].astype(np.uint32)
    tri = (pad[:-3] * 961 + pad[1:-2] * 31 + pad[2:-1]) * U(2654435761) >> U(7) & U((1 << BITS) - 1)
    c, down = prefix_hash(low, BYTE_TABLE)
    cols = []
    for n in (1, 2, 3):
        e, s = np.minimum(starts + n, ends), np.maximum(ends - n, starts)
        cols.append((c[e] - c[starts]) * down[starts] + U(2 * n))
        cols.append((c[ends] - c[s]) * down[s] + U(2 * n + 1))
    cols.append((c[ends] - c[starts]) * down[starts] + U(99))
    own = np.stack([mix(x) >> U(64 - BITS) for x in cols], 1).astype(np.int64) if len(starts) else np.zeros((0, 7), np.int64)
    return own, tri.astype(np.int64)


def emissions(own: np.ndarray, tri: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, lot: int = 16_384) -> np.ndarray:
    """A row of language scores for each word; weights: (2, 2**BITS, languages), of words' and bytes' features.

    Words go lot by lot, so that sums over bytes stay small.
    """
    out = np.empty((len(starts), weights.shape[2]))
    for a in range(0, len(starts), lot):
        s, e = starts[a : a + lot], ends[a : a + lot]
        total = np.zeros((e[-1] - s[0] + 1, weights.shape[2]))
        np.cumsum(weights[1][tri[s[0] : e[-1]]], axis=0, out=total[1:])
        part = (total[e - s[0]] - total[s - s[0]]) / np.maximum(e - s, 1)[:, None] ** 0.5
        for k in range(own.shape[1]):
            part += weights[0][own[a : a + lot, k]]
        out[a : a + lot] = part
    return out


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (segments, SEGMENT), -1 beyond a document's end, and the document of each segment; in order."""
    n = np.diff(first)
    per = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = first[:-1][doc][:, None] + nth[:, None] * SEGMENT + np.arange(SEGMENT)
    return np.where(at < first[1:][doc][:, None], at, -1), doc


def transfers(e: np.ndarray, m: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Each segment's matrix, up to a factor: a message before it, times the matrix, is the message at its end."""
    n, t, k = e.shape
    out = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for i in range(t):
        live = real[:, i]
        if not live.any():
            break
        new = (out[live] @ m) * e[live, i][:, None, :]
        out[live] = new / new.max((1, 2), keepdims=True)
    return out


def messages(e: np.ndarray, m: np.ndarray, real: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Message that enters each segment from before (zero: it starts its chain), and from behind at its end."""
    n, _, k = e.shape
    start = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    before, behind = np.zeros((n, k)), np.ones((n, k))
    if start.all():
        return before, behind
    nth = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    last = np.r_[start[1:], True]
    many = np.flatnonzero(~(start & last))  # segments of chains that have several
    step = np.zeros((n, k, k))
    step[many] = transfers(e[many], m, real[many])
    # a chain's first segment starts from equal odds instead of a transition
    opening = many[start[many]]
    here = np.linalg.solve(m.T, np.full(k, 1 / k))
    leave = np.zeros((n, k))
    leave[opening] = np.einsum("k,nkj->nj", here, step[opening])
    by = np.argsort(nth[many], kind="stable")
    order, cut = many[by], np.searchsorted(nth[many][by], np.arange(nth.max() + 2))
    for j in range(1, len(cut) - 1):
        at = order[cut[j] : cut[j + 1]]
        before[at] = leave[at - 1] / leave[at - 1].sum(1, keepdims=True)
        leave[at] = np.einsum("ni,nij->nj", before[at], step[at])
    for j in range(len(cut) - 2, 0, -1):
        at = order[cut[j] : cut[j + 1]]
        back = np.einsum("nij,nj->ni", step[at], behind[at])
        behind[at - 1] = back / back.max(1, keepdims=True)
    return before, behind


def forward_backward(score: np.ndarray, moves: np.ndarray, real: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (segments, SEGMENT, languages) and summed expected transitions; score: log emissions; doc: each segment's chain."""
    n, t, k = score.shape
    e = np.where(real[:, :, None], np.exp(score - score.max(2, keepdims=True)), 1.0)
    m = np.exp(moves - moves.max())
    before, behind = messages(e, m, real, doc)
    entered = before.any(1)
    fwd = np.empty((t, n, k))
    for i in range(t):
        a = np.where(entered[:, None], (before @ m) * e[:, 0], e[:, 0]) if not i else np.where(real[:, i, None], (fwd[i - 1] @ m) * e[:, i], fwd[i - 1])
        fwd[i] = a / a.sum(1, keepdims=True)
    post, trans = np.empty((n, t, k)), np.zeros((k, k))
    b = behind
    for i in range(t - 1, -1, -1):
        p = fwd[i] * b
        post[:, i] = p / p.sum(1, keepdims=True)
        nb = e[:, i] * b
        back = nb @ m.T
        live = real[:, i] if i else entered
        prev = fwd[i - 1] if i else before
        z = (prev * back).sum(1)
        trans += m * ((prev[live] / z[live, None]).T @ nb[live])
        b = np.where(live[:, None], back, b)
        b = b / b.max(1, keepdims=True)
    return post, trans


def spliced(first: np.ndarray, label: np.ndarray, share: float = 0.3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and labels of the training chains, and where each chain starts: some documents go on as another one."""
    rng = np.random.default_rng(seed)
    words, names, starts = [], [], [0]
    for d in range(len(label)):
        at = np.arange(first[d], first[d + 1])
        own = np.full(len(at), label[d])
        if rng.random() < share and len(at):
            o, cut = int(rng.integers(len(label))), int(rng.integers(len(at))) + 1
            other = np.arange(first[o], first[o + 1])[:len(at)]
            at, own = np.r_[at[:cut], other], np.r_[own[:cut], np.full(len(other), label[o])]
        words.append(at)
        names.append(own)
        starts.append(starts[-1] + len(at))
    return np.concatenate(words), np.concatenate(names), np.array(starts)


def train(texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.25, l2: float = 1e-4, seed: int = 5) -> dict:
    """A model from whole labelled texts, by full-batch adaptive gradient steps on the chains' log likelihood."""
    names = sorted(set(langs))
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(r) for r in raw])]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = words_of(buf, offs)
    word, truth, chain = spliced(first, np.array([names.index(x) for x in langs]), seed=seed)
    grid, doc = segments(chain)
    real = grid >= 0
    label = np.where(real, truth[np.where(real, grid, 0)] if len(truth) else 0, 0)
    grid = np.where(real, word[np.where(real, grid, 0)] if len(word) else 0, -1)
    own, tri = features(buf, starts, ends)
    s, e = starts, ends
    k = len(names)
    w, m = np.zeros((2, 1 << BITS, k)), np.eye(k) * 2.0
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    gold = np.eye(k)[label] * real[:, :, None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    over = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    gold_moves += gold[over - 1, -1].T @ gold[over, 0]
    spans = np.repeat(np.arange(len(s)), e - s)
    at = np.repeat(s - np.r_[0, np.cumsum(e - s)[:-1]], e - s) + np.arange((e - s).sum())
    tri_at, root = tri[at], 1 / np.maximum(e - s, 1) ** 0.5
    n = max(1, int(real.sum()))
    for _ in range(rounds):
        em = emissions(own, tri, s, e, w)
        post, trans = forward_backward(em[np.where(real, grid, 0)] if len(em) else np.zeros((*real.shape, k)), m, real, doc)
        diff = (gold - post * real[:, :, None])[real]
        g = np.stack([np.bincount(grid[real], diff[:, c], len(s)) for c in range(k)], 1)
        grad = np.zeros_like(w)
        for c in range(k):
            for f in range(own.shape[1]):
                grad[0, :, c] += np.bincount(own[:, f], g[:, c], 1 << BITS)
            grad[1, :, c] = np.bincount(tri_at, (g[:, c] * root)[spans], 1 << BITS)
        grad = grad / n * 100 - l2 * w
        gw += grad**2
        w += rate * grad / np.sqrt(gw)
        step = (gold_moves - trans) / n
        gm += step**2
        m += rate * step / np.sqrt(gm)
    return {"names": names, "weights": w.astype(np.float32), "moves": m}


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(model: dict, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document of flat text its language's number (-1: und) and mean posterior."""
    docs = len(offs) - 1
    starts, ends, first = words_of(buf, offs)
    best, score = np.full(docs, -1), np.zeros(docs)
    if len(starts) and model["names"]:
        k = len(model["names"])
        em = emissions(*features(buf, starts, ends), starts, ends, model["weights"])
        grid, doc = segments(first)
        total = np.zeros((docs, k))
        ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1
        a = 0
        while a < len(doc):  # whole chains, as many as make about 4096 segments
            b = int(ends[min(np.searchsorted(ends, max(a + 4096, ends[np.searchsorted(ends, a + 1)]), "right"), len(ends)) - 1])
            part, real = grid[a:b], grid[a:b] >= 0
            post, _ = forward_backward(em[np.where(real, part, 0)], model["moves"], real, doc[a:b])
            np.add.at(total, doc[a:b], (post * real[:, :, None]).sum(1))
            a = b
        n = np.diff(first)
        some = n > 0
        best[some] = total[some].argmax(1)
        score[some] = np.clip(total[some].max(1) / n[some], 0, 1)
        ascii_letter = np.r_[0, np.cumsum(LETTER[buf] & (buf < 128))]
        for d in np.flatnonzero(some & (ascii_letter[offs[1:]] == ascii_letter[offs[:-1]])):
            if not _has_letter(buf[offs[d] : offs[d + 1]].tobytes()):
                best[d], score[d] = -1, 0.0
    return best, score


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from a bounded sample of labelled rows: per language the PER_LANGUAGE rows of least hash, ties by their values."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    keyed = known.select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("t"))
    least = keyed.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))).where(f"r <= {PER_LANGUAGE}").orderBy("r", "l").limit(MAX_ROWS)
    chosen = {}
    for r in least.collect():
        chosen[r["i"], r["l"], r["t"]] = chosen.get((r["i"], r["l"], r["t"]), 0) + 1
    # the chosen rows' texts, one for rows that are the same in all three
    text = known.where(F.col(id_col).isin(sorted({i for i, _, _ in chosen}))).groupBy(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(F.col(text_col)).alias("t")).agg(F.first(text_col).alias("text"))
    wanted = docs.sparkSession.createDataFrame(list(chosen), docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.lit(0).cast("long").alias("t")).schema) if chosen else None
    rows = sorted((r["i"], r["l"], r["t"], r["text"]) for r in text.join(F.broadcast(wanted), ["i", "l", "t"], "left_semi").collect()) if chosen else []
    rows = [r for r in rows for _ in range(chosen[r[:3]]) if r[3]]
    return train([r[3] for r in rows], [r[1] for r in rows]) if rows else {"names": [], "weights": np.zeros((2, 1 << BITS, 1), np.float32), "moves": np.zeros((1, 1))}


def identify(docs: DataFrame, model: dict, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its mean posterior."""
    docs = without(docs, out, score)
    names = docs.columns
    at = [n.lower() for n in names].index(text_col.lower())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        label = np.array([*model["names"], "und"], object)
        for rb in batches:
            data, offs = flat(rb.column(at).cast(pa.string()))
            langs, scores = [], []
            for i, j in slices(offs, 1 << 19):
                best, s = predict(model, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                langs += label[best].tolist()
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, out, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean_batches(rows), f"{fields}, `{out}` string, `{score}` double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score): learns from rows whose crc32(id as text) mod folds is not 0."""
    fold = F.expr(crc_mod(f"`{id_col}`", folds))
    model = train_on(docs.where(fold != 0), id_col, text_col, lang_col)
    return identify(docs.select(F.col(id_col), F.col(text_col)), model, text_col).select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

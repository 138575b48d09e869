"""Corpus operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, batch long, spans string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "of", "an", "er", "ing", "qu", "ç", "z"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = prose(rng, 80)
    out = [None, "", "  \n ", "one", "One", "a b c d", "a b c d e", "x " * 300, *base, base[3], base[3].upper(), shared, base[5] + " " + shared, shared + " tail " + base[6]]
    for i in range(12):
        words = base[10 + i].split()
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out.append(prose(rng, 6000))
    out.append(out[-1][:20000] + " end")
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(t):
    w = WORDS.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_jaccard_components(docs, texts):
    from weft.llm.jaccard import jaccard_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_jaccard_empty_and_null_ids(spark, docs):
    from weft.llm.jaccard import jaccard_components

    assert jaccard_components(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "", "", 0, 0, 0, ""), (4, "a b c d e f", "", "", 0, 0, 0, ""), (4, "a b c d e f", "", "", 0, 0, 0, "")], SCHEMA)
    assert [r["component_id"] for r in jaccard_components(rows).collect()] == [4, 4, 4]


def brute_removed(texts, n=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i : i + n] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, texts):
    from weft.llm.suffix_dedup import remove_repeats

    got = remove_repeats(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == dict(enumerate(brute_removed(texts)))
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [2, 9, 50])
def test_short_repeats(spark, length):
    from weft.llm.suffix_dedup import remove_repeats

    rng = random.Random(length)
    texts = ["".join(rng.choice("abcdefgh" if length < 50 else "ab") for _ in range(rng.randint(0, 300 if length == 50 else 40))) for _ in range(12)] + ["", None]
    texts += [texts[0][:60] + "!" + texts[1]]
    got = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), length=length).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(brute_removed(texts, length)))


def test_repeated_rows_match_each_other(spark):
    with pytest.raises(ValueError):
        from weft.llm.suffix_dedup import gram_of

        gram_of(1)
    _repeated_rows(spark)


def _repeated_rows(spark):
    from weft.llm.suffix_dedup import remove_repeats

    text = prose(random.Random(1), 90)
    rows = spark.createDataFrame([(1, text), (1, text), (None, text + "!"), (None, "short")], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in remove_repeats(rows).collect())
    n = len(text.encode())
    assert got == [(5, 0), (n, n), (n, n), (n + 1, n)]


def test_merge_of_front_coded_runs():
    from weft.llm.suffix_dedup import common, front_code, front_decode, merge_runs

    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    got = list(merge_runs([front_decode(*front_code(r)) for r in runs]))
    assert [s for _, s, _ in got] == sorted(sum(runs, []))
    assert [n for _, _, n in got[1:]] == [common(a, b) for (_, a, _), (_, b, _) in zip(got, got[1:], strict=False)]


def test_bpe_is_the_library(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from weft.llm.bpe import Bpe, bpe_decode, bpe_digests, bpe_encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    odd = ["".join(rng.choice([*"ab  \n\t\x0b\x85é'12٣%漢😀‍ß", "<|endoftext|>", "'ll"]) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    own = Bpe(open(path, "rb").read())
    for t in odd + ["z" * 3000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert all(r["decoded"] == (r["text"] or "") for r in bpe_decode(bpe_encode(docs, path), path).collect())


def test_language_held_out(spark):
    from weft.llm.langid import identify_held_out

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !! 34", None, None, None), (10**6 + 2, "", "fr", "s", 0)], docs.schema)
    rows = {r["doc_id"]: r for r in identify_held_out(docs.union(extra)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    assert sum(rows[d]["lang_pred"] == truth[d] for d in held) > 0.97 * len(held)
    assert [rows[10**6 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_words_of_mixed_text_get_their_own_language(spark):
    from weft.llm import langid

    rng = random.Random(5)
    make = lambda stems: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(400))
    a, b = ["the", "ing", "wh"], ["eau", "ée", "ou"]
    model = langid.train([make(a), make(b), make(a), make(b)], ["x", "y", "x", "y"])
    raw = (" ".join(make(a).split()[:30]) + " " + " ".join(make(b).split()[:30])).encode()
    buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, ends, first = langid.words_of(buf, offs)
    score = langid.emissions(*langid.features(buf, starts, ends), starts, ends, model["weights"])
    grid, doc = langid.segments(first)
    post, _ = langid.forward_backward(score[np.where(grid >= 0, grid, 0)], model["moves"], grid >= 0, doc)
    best = post[0].argmax(1)
    assert (best[:30] == 0).mean() > 0.9 and (best[30:60] == 1).mean() > 0.9


def naive_chain(score, moves):
    """Posteriors and expected transitions of one chain, in logarithms, word by word."""
    n, k = score.shape
    fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
    lse = lambda x, axis: np.log(np.exp(x - x.max()).sum(axis)) + x.max()
    fwd[0] = score[0] - np.log(k)
    for t in range(1, n):
        fwd[t] = lse(fwd[t - 1][:, None] + moves, 0) + score[t]
    for t in range(n - 2, -1, -1):
        bwd[t] = lse(moves + score[t + 1] + bwd[t + 1], 1)
    z = lse(fwd[-1], 0)
    trans = sum((np.exp(fwd[t - 1][:, None] + moves + score[t] + bwd[t] - z) for t in range(1, n)), np.zeros((k, k)))
    return np.exp(fwd + bwd - z), trans


def test_forward_backward_is_one_pass_over_each_chain():
    import itertools

    from weft.llm import langid

    rng = np.random.default_rng(9)
    lengths = [3, 64, 65, 200, 1, 128, 130]
    first = np.r_[0, np.cumsum(lengths)]
    score, moves = rng.normal(0, 2, (first[-1], 3)), rng.normal(0, 1, (3, 3))
    grid, doc = langid.segments(first)
    real = grid >= 0
    post, trans = langid.forward_backward(score[np.where(real, grid, 0)], moves, real, doc)
    naive = [naive_chain(score[a:b], moves) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert np.allclose(post[real], np.concatenate([p for p, _ in naive]), atol=1e-9)
    assert np.allclose(trans, sum(t for _, t in naive), atol=1e-8)
    paths = list(itertools.product(range(3), repeat=3))  # and the naive pass is an enumeration of all paths
    weight = np.array([np.exp(sum(score[t, y[t]] for t in range(3)) + sum(moves[y[t - 1], y[t]] for t in (1, 2))) for y in paths])
    for t in range(3):
        assert np.allclose([weight[[y[t] == c for y in paths]].sum() / weight.sum() for c in range(3)], naive[0][0][t])


def test_language_learns_from_rows_in_a_total_order(spark):
    from weft.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(60)
    twice = docs.union(docs.withColumn("text", __import__("pyspark.sql.functions", fromlist=["x"]).reverse("text"))).withColumn("lang_pred", docs["lang"])
    a, b = langid.train_on(twice.repartition(1)), langid.train_on(twice.repartition(5))
    assert a["names"] == b["names"] and np.array_equal(a["weights"], b["weights"])
    got = langid.identify(twice, a)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == 120
    assert langid.identify(docs.limit(0), a).count() == 0 and langid.identify_held_out(docs.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 2 * sizes[s] for s in over}


def test_mixing(docs, texts):
    from weft.llm.mixing import mix_sources

    rows = mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    again = {r["doc_id"]: r["taken"] for r in mix_sources(docs.repartition(2)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[f"s{i % 3}" if i % 5 else None] += len(WORDS.findall(t or ""))
    want, got, least = brute_targets(sizes), collections.Counter(), {}
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r["doc_id"]] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        got[r["source"]] += r["taken"]
        least[r["source"]] = min(least.get(r["source"], 10**9), r["size"] or 10**9)
    # one document has 6000 of the null source's words, and all others twice don't make up for a copy of it
    assert all(abs(got[s] - want[s]) <= least[s] for s in want if s is not None)
    assert got[None] == 6000 + 2 * (sizes[None] - 6000) < want[None]
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixing_solves_the_dual(spark):
    from weft.llm.mixing import balance, tilt
    from pyspark.sql import functions as F

    rng = random.Random(23)
    sizes = {s: [rng.randint(1, 400) for _ in range(60)] for s in ("a", "b", "c")}
    share = {"a": 0.2, "b": 1.7, "c": 2.0}
    cells = spark.createDataFrame([(s, n, sizes[s].count(n)) for s in sizes for n in set(sizes[s])], "skey string, size long, docs long")
    wanted = spark.createDataFrame([(s, sum(sizes[s]), share[s] * sum(sizes[s])) for s in sizes], "skey string, words long, target double")
    lam = {r["skey"]: r["lam"] for r in balance(cells, wanted, 2.0).collect()}
    rate = {(r["skey"], r["size"]): r["r"] / 1e9 for r in cells.join(balance(cells, wanted, 2.0), "skey").select("skey", "size", tilt(2.0).alias("r")).collect()}
    for s, each in sizes.items():
        low, high = -9.0, float(np.log(2))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if sum(n * min(2.0, np.exp(mid * n)) for n in each) > share[s] * sum(each) else (mid, high)
        assert s == "c" or abs(lam[s] - mid) < 1e-9
        assert all(abs(rate[s, n] - min(2.0, np.exp(lam[s] * n))) < 2e-9 for n in each)
        assert abs(sum(n * rate[s, n] for n in each) - share[s] * sum(each)) < 1e-5


def test_mixing_repeats_blanks_and_clashing_columns(spark):
    from weft.llm.mixing import mix_sources

    rows = [(1, "a b c", "x", "own", 5)] * 7 + [(None, None, None, "own", 5), (2, "", "x", "own", 5), (3, "w " * 5000, None, "own", 5)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, Size string, copies int").repartition(3)).collect()
    assert got[0].__fields__ == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"] and len(got) == 10
    by = collections.Counter()
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["copies"] == 1 if not r["size"] else 0 <= r["copies"] <= 2
    assert by["x"] == 42 and by[None] in (5000, 10000)


def test_media(docs, texts):
    from weft.llm import media

    for r in media.text_media(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r["media_bytes"] == 44 + len(pay) and hashlib.sha256(media.store(pay)).hexdigest() == r["media_sha256"]


def test_sniffing_and_carving(spark):
    import struct

    from weft.llm import media

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav, gif = media.store(b"abcd"), b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2\x44\1\0;"
    assert media.corrected(png, "image/gif") == "image/png" and media.corrected(gif) == "image/gif" and media.corrected(wav) == "audio/wav"
    assert media.corrected(png[:-3], "image/png") == media.UNKNOWN and media.corrected(b"BM but no bitmap", "text/plain") == "text/plain"
    mixed = b"junk RIFF" + png + b"--" + wav + gif
    assert [(k, m) for _, k, m in media.carve(mixed)] == [("image/png", png), ("audio/wav", wav), ("image/gif", gif)]
    rows = media.sniff_media(spark.createDataFrame([(1, bytearray(png), "x/y"), (2, None, None)], "id long, m binary, said string"), "m", "said").orderBy("id").collect()
    assert [r["media_type"] for r in rows] == ["image/png", media.UNKNOWN]


def test_media_features_repeats_and_updates(spark):
    import time

    from weft.llm import media

    texts = ["", None, "abc", "abc", "ü" * 5000, "x" * 64, "%PDF-1.4 1 0 obj startxref 9 %%EOF more startxref 10 %%EOF tail", "BM RIFF GIF89a %PDF-1.9"]
    rows = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, feature string, n_bytes int")
    got = {r["doc_id"]: r["feature"] for r in media.text_media(rows).collect()}
    for i, t in enumerate(texts):
        pay = np.frombuffer((t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 or (0 if t else 64)), np.uint8).astype(int)
        inside = "application/pdf" if i == 6 else "-"
        assert got[i] == f"audio/wav;rate=8000;bits=8;samples={len(pay)};mean={pay.mean():.4f};crossings={(np.diff(pay >= 128) != 0).sum()};embedded={inside}"
    assert got[2] == got[3] and media.text_media(rows.limit(0)).count() == 0
    (_, kind, body), = media.carve(b"-" + texts[6].encode())
    assert (kind, body) == ("application/pdf", texts[6].encode()[: -len(" tail")])
    began = time.process_time()
    assert media.sniff(b"%PDF-1.4 " * 100_000) == [] and time.process_time() - began < 3
    clash = media.sniff_media(rows.selectExpr("doc_id", "cast(text as binary) m", "feature media_type"), "m")
    assert clash.columns == ["doc_id", "m", "media_type", "embedded"] and clash.where("doc_id = 6").first()["media_type"] == "application/pdf"


def test_quality_held_out(spark):
    from weft.llm.quality import score_held_out

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**6, None, None, None, None)], docs.schema)
    rows = {r["doc_id"]: r for r in score_held_out(docs.union(extra), labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in rows}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(rows[d]["predicted"] == truth[d] for d in held) > 0.93 * len(held)
    assert 0 <= rows[10**6]["score"] <= 1
    assert score_held_out(docs.limit(5), labels.limit(0)).first()["score"] == 0.5


def test_factorisation_machine_sums_all_pairs():
    from weft.llm import quality

    rng = np.random.default_rng(4)
    buckets, dense = 1 << quality.BITS, rng.normal(size=(3, 5))
    m = {"w0": rng.normal(size=1), "w": rng.normal(size=buckets), "v": rng.normal(size=(buckets, quality.RANK)), "dw": rng.normal(size=5), "dv": rng.normal(size=(5, quality.RANK))}
    d, b, x = np.array([0, 0, 0, 2, 2]), np.array([3, 9, 11, 3, 500]), rng.normal(size=5)
    got, _ = quality.margin(m, dense, d, b, x)
    for doc in range(3):
        parts = [(m["w"][b[e]], m["v"][b[e]], x[e]) for e in np.flatnonzero(d == doc)] + [(m["dw"][i], m["dv"][i], dense[doc, i]) for i in range(5)]
        want = m["w0"][0] + sum(w * v for w, _, v in parts) + sum((p[1] @ q[1]) * p[2] * q[2] for i, p in enumerate(parts) for q in parts[i + 1 :])
        assert abs(got[doc] - want) < 1e-9


def test_quality_learns_from_rows_in_a_total_order(spark):
    from pyspark.sql import functions as F

    from weft.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs.withColumn("text", F.reverse("text"))).withColumn("score", F.lit("own"))
    a, b = quality.train_on(twice.repartition(1), labels), quality.train_on(twice.repartition(5), labels)
    assert all(np.array_equal(a[k], b[k]) for k in ("w0", "w", "v", "dw", "dv"))
    got = quality.score_texts(twice, a)
    assert got.columns == [*docs.columns, "score"] and got.count() == 2 * docs.count() and dict(got.dtypes)["score"] == "double"
    assert quality.score_held_out(docs.limit(0), labels).count() == 0
    one = labels.where("quality = 1")
    assert {r["score"] for r in quality.score_held_out(docs, one).collect()} == {1.0}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from weft.llm.common import materialize

    dir_ = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{dir_}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], dir_), name.replace(" ", "-")))
    assert all(s.columns == docs.columns for s in steps[:-1])
    one = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    ids = sorted(one)
    comps = brute_components([one[i] for i in ids])
    two = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert set(two) == {ids[c] for _, c in comps}
    ids = sorted(two)
    cut = dict(zip(ids, brute_removed([two[i] for i in ids]), strict=True))
    three = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert set(three) == {i for i in ids if not (0 < cut[i][1] == cut[i][0])}
    assert all(three[i] == two[i] for i in three if not cut[i][1])
    sizes = collections.Counter()
    source = {r["doc_id"]: (r["source"], len(WORDS.findall(r["text"] or ""))) for r in steps[3].collect()}
    for name, n in source.values():
        sizes[name] += n
    taken, words = collections.Counter(), collections.Counter()
    four = steps[4].collect()
    for r in four:
        taken[r["doc_id"]] += 1
        words[r["source"]] += source[r["doc_id"]][1]
        assert r["text"] == three[r["doc_id"]]
    assert max(taken.values()) <= 2 and all(words[name] <= 2 * sizes[name] for name in sizes)
    assert abs(sum(words.values()) - sum(brute_targets(sizes).values())) < 0.05 * sum(sizes.values())
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for r in four for ids in [library.encode(r["text"] or "", add_special_tokens=False).ids])
    assert sorted(tuple(r)[:3] for r in steps[5].select("doc_id", "n_tokens", "ids_sha256").collect()) == want
    assert steps[5].count() == steps[4].count() == len([r for r in corpus_pipeline.run(spark, dir_).collect()])


def test_pipeline_on_empty_tables_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    rng = random.Random(31)
    a, b = prose(rng, 90), prose(rng, 90)
    odd = [(None, a, None, None, None), (None, b, "en", None, 3), (7, prose(rng, 50), None, "x", 1), (7, prose(rng, 60), None, "x", 1), (None, None, None, None, None), (9, "", "en", "x", 0), (10, "1 2", "en", "x", 3), (11, prose(rng, 20000), None, "x", None)]
    docs.union(spark.createDataFrame(odd, schema)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, f"{tmp_path}/odd")
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {(i, t) for i, t, *_ in odd if t and any(c.isalpha() for c in t)} <= texts and not any(t is None or not any(c.isalpha() for c in t) for _, t in texts)
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0


def test_near_duplicates_keep_a_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, a + " more"), (1, c), (1, d), (1, c), (2, e), (None, e), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got[0] == (0, "") and got[-2:] == [(3, ""), (3, "")] and len(got) == 8
    assert (1, c) in got and (1, d) in got and (2, e) in got and (0, b) in got and ((0, a) in got) != ((0, a + " more") in got)


def test_language_stage_keeps_mixed_text(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    by: dict = {}
    for r in docs.where("text is not null and lang is not null").orderBy("doc_id").collect():
        by.setdefault(r["lang"], []).extend(r["text"].split())
    parts = sorted(by)[:3]
    mixed = " ".join(w for lang, n in zip(parts, (40, 35, 25), strict=True) for w in by[lang][:n])
    extra = spark.createDataFrame([(10**6, mixed, None, "s", len(mixed)), (10**6 + 1, "1 2 3", None, "s", 5)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(extra), "").collect()}
    assert 10**6 in kept and 10**6 + 1 not in kept


def changed(text, *at):
    return " ".join(f"new{i}" if i in at else w for i, w in enumerate(text.split()))


def test_frequent_shingles_go_once(monkeypatch):
    import pyarrow as pa

    from weft.llm import jaccard

    rng = random.Random(29)
    line = "all of them have this one line in common here"
    texts = [f"{line} {prose(rng, 12)}" for _ in range(40)] + [prose(rng, 30) for _ in range(5)] + [line, None, "x"]

    def run(many):
        monkeypatch.setattr(jaccard, "MANY", many)
        batches = [pa.RecordBatch.from_arrays([pa.array(list(range(a, b)), pa.int64()), pa.array(texts[a:b], pa.string()), pa.array([0] * (b - a), pa.int64())], ["doc_id", "text", "mark"]) for a, b in ((0, 30), (30, len(texts)))]
        sent = pa.Table.from_batches([r for n, b in enumerate(batches) for r in jaccard._shingles(7, 5)(iter([b]))])
        sent = sent.set_column(1, "batch", pa.array(np.cumsum(np.array(sent["kind"]) == 1) + 100))  # each call counts as a task
        size = sum(map(len, sent.filter(pa.compute.equal(sent["kind"], 0))["blob"].to_pylist()))
        back = pa.concat_tables([jaccard._shared(sent.filter(pa.compute.equal(sent["key"], k))) for k in range(max(sent["key"].to_pylist()) + 1)])
        got = [jaccard._documents(80)(back.filter(pa.compute.equal(back["batch"], b))) for b in sorted(set(back["batch"].to_pylist()))]
        return sorted(map(repr, pa.concat_tables(got).to_pylist())), size

    pytest.importorskip("pyarrow.compute")
    (some, small), (none, large) = run(10), run(10**9)
    assert some == none and small < large


def test_jaccard_links_give_every_pair(spark):
    from weft.llm.jaccard import jaccard_links

    base = prose(random.Random(13), 200)
    texts = [base, *(changed(base, 20 * i) for i in range(1, 6)), base.upper(), "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table, reps, links = jaccard_links(docs)
    rep = {r["no"]: r["rep"] for r in reps.collect()}
    assert sorted(tuple(sorted((rep[r["a"]], rep[r["b"]]))) for r in links.collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


def test_jaccard_links_through_null_ids(spark):
    from weft.llm.jaccard import jaccard_components

    base, other = prose(random.Random(17), 200), prose(random.Random(19), 200)
    rows = [(None, base), (2, changed(base, 20, 40, 60, 80)), (1, changed(base, 100, 120, 140, 160)), (7, base + " a"), (7, other), (5, changed(other, 50)), (None, "a b c d e f"), (None, "a b c d e g")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (5, 5), (7, 1), (7, 5)]

"""Alignment, ranked search and prefix counts against brute force and the tokenizers' libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
A, B, W = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = "the of an Über qué harbour 's 're it's 12 ingot λόγος ΣΑΣ 日本語 naïve café <|endoftext|> <s> <0x41> ▁ x!? ... ​ 😀 </w>".split()
    some = [" ".join(rng.choice(words) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    odd = [None, "", " ", "   ", "a", "A", "a ", " a", "a  b   c ", "it's  '  'll \n x", "\t\n", "\x00 x", "é ́x", "한", "<|startoftext|> hi<|endoftext|>!<|end", "x" * 3000, "ab " * 900, "é" * 400, "\x0b\x0c\x85　z", "İI"]
    return [*some, *odd, some[0], "a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return rows, spark.createDataFrame([*rows, rows[7]], DOCS).repartition(5).cache()


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned_plain(rows):
    """What op11 returns, from the libraries' encodings of whole texts and dictionaries of ends."""
    from weft.llm.bpe import byte_chars

    a, b = libraries()
    back = {c: i for i, c in enumerate(byte_chars())}
    links, made = Counter(), []
    for doc_id, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        ends, joined, spans = [], [], []
        for side in range(2):
            ids = (a.encode(" " + text, add_special_tokens=False).ids if side == 0 else b.encode(text)) if text else []
            strings = [bytes(back[c] for c in a.id_to_token(i)) if side == 0 else (bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
            joined.append(b"".join(strings))
            at, end = 0, {}
            for i, s in zip(ids, strings, strict=True):
                at += len(s)
                end[at] = i
            ends.append(end)
            spans.append(ids)
        if not text or joined != [raw, raw]:
            made.append((doc_id, 0, 0, [], [], ""))
            continue
        cuts = sorted(set(ends[0]) & set(ends[1]))
        pairs = [(ends[0][c], ends[1][c]) for c in cuts]
        links.update(pairs)
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(e[x]) for x in sorted(e) if lo < x <= c) for e in ends))
            lo = c
        made.append((doc_id, len(spans[0]), len(spans[1]), cuts, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, len(c), len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), s) for d, na, nb, c, p, s in made], links, best


@pytest.mark.parametrize("lot", [400, 2 << 20])
def test_alignment_equals_whole_encodings(docs, monkeypatch, lot):
    from weft.llm import align

    monkeypatch.setattr(align, "LOT", lot)
    rows, df = docs
    rows = [*rows, rows[7]]
    want, links, best = aligned_plain(rows)
    got = align.align(df, A, B).collect()
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in got)
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in align.pair_counts(df, A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in links.items()}


def test_token_groups_and_wider_links(spark, docs):
    from weft.llm import align

    _, df = docs
    got = {r["doc_id"]: r for r in align.token_groups(df.withColumnRenamed("lang", "GROUPS"), A, B).collect()}
    assert "GROUPS" not in got[1].asDict()
    a, b = libraries()
    for i in (0, 3, 9, 20):
        text, groups = got[i]["text"], got[i]["groups"]
        if groups:
            assert [x for g in groups for x in g["a"]] == a.encode(" " + text, add_special_tokens=False).ids and [x for g in groups for x in g["b"]] == b.encode(text)
            assert groups[0]["start"] == 0 and groups[-1]["end"] == len((" " + text).encode()) and all(x["end"] == y["start"] for x, y in zip(groups, groups[1:], strict=False))
    i, j = align.links(np.array([1, 3, 6]), np.array([2, 3, 4, 6]), "group")
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]
    i, j = align.links(np.array([1, 3, 6]), np.array([2, 3, 4, 6]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 1), (2, 3)]
    wide = {r["doc_id"]: r["n_links"] for r in align.align(df, A, B, scope="group").collect()}
    assert wide[0] == sum(len(g["a"]) * len(g["b"]) for g in got[0]["groups"])
    with pytest.raises(ValueError):
        align.align(df, A, B, scope="other")
    assert align.align(df.limit(0), A, B).count() == 0


def searched_plain(docs, items, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(term(t))) for d, t, *_ in docs if term(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(term(text)) if c[w])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize(("shard", "block", "fan"), [(300, 200, 2), (8 << 20, 1 << 20, 64)])
def test_search_equals_plain_scores(spark, docs, monkeypatch, shard, block, fan):
    from weft.llm import lexical

    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "FAN_IN", fan)
    rows, df = docs
    rows = [*rows, rows[7]]
    items = [(1, "the harbour ingot"), (2, "THE the λόγος 日本語0"), (3, None), (4, " .,"), (5, "naïve naïve café zzz"), (5, "a"), (None, "x the")]
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = lexical.search(lexical.build(df), asked, k=7).collect()
    assert sorted(map(repr, searched_plain(rows, items, 7))) == sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got)
    assert lexical.search(lexical.build(df.limit(0)), asked).count() == 0 and lexical.search(lexical.build(df), asked.limit(0)).count() == 0


def test_best_keeps_ties_in_order():
    from weft.llm.lexical import best

    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = rng.integers(1, 40), rng.integers(1, 12)
        score, order = rng.integers(0, 5, n), rng.permutation(n)
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], order[i]))[:k]
        assert best(score, k, order).tolist() == want


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(W)


def test_every_prefix_has_the_librarys_count(words):
    from weft.llm.token_counts import Prefixes, longest_within

    with open(W, "rb") as f:
        model = Prefixes(f.read())
    count = lambda t: len(words.encode(t, add_special_tokens=False).ids)
    seen = 0
    for t in texts(n=30):
        t = (t or "")[:120]
        got = model.counts(t)
        assert len(got) == len(t) + 1 and got[0] == 0 and got[-1] == count(t)
        for i, n in enumerate(got.tolist()):
            assert n == -1 or n == count(t[:i]), (t, i)
            seen += n >= 0
        for budget in (0, 1, 5, 10**6):
            end = longest_within(got, budget)
            assert count(t[:end]) <= budget and all(count(t[:i]) > budget for i in range(end + 1, len(t) + 1) if got[i] >= 0)
    assert seen > 1000 and model.counts("é").tolist() == [0, -1, 1]


def test_counts_in_lots_and_questions(spark, docs, words, monkeypatch):
    from weft.llm import token_counts

    monkeypatch.setattr(token_counts, "LOT", 500)
    monkeypatch.setattr(token_counts, "MEMO", 50)
    rows, df = docs
    want = [(d, len((t or "").encode()), n := len(words.encode(t or "", add_special_tokens=False).ids), n > 20) for d, t, *_ in [*rows, rows[7]]]
    got = token_counts.token_counts(df, W, limit=20).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in got)
    held = token_counts.store_counts(df.withColumnRenamed("lang", "Prefixes"), W)
    asked = {r["doc_id"]: r for r in token_counts.ask_budgets(held, [0, 3, 10**6]).collect()}
    cut = {r["doc_id"]: r["within"] for r in token_counts.truncate(df, W, 3).collect()}
    full = {r["doc_id"]: r["prefix_tokens"] for r in token_counts.prefix_counts(df, W).collect()}
    for d, r in asked.items():
        text = r["text"] or ""
        assert text[: r["fits"][1]] == cut[d] and r["fits"][2] == len(text) and len(full[d]) == len(text) + 1
    assert token_counts.token_counts(df.limit(0), W).count() == 0


def test_long_runs_take_linear_time(words):
    import time

    from weft.llm.token_counts import Prefixes

    with open(W, "rb") as f:
        model = Prefixes(f.read())
    for unit in ("abcdefgh", "a", "!", "1", "日本", "'re"):
        took = []
        for n in (20_000, 80_000):
            t = unit * (n // len(unit))
            began = time.process_time()
            got = model.counts(t)[-1]
            took.append(time.process_time() - began)
        assert got == len(words.encode(t, add_special_tokens=False).ids) and took[1] < 20 * max(took[0], 0.02)

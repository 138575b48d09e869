"""HTML, WARC and nearest neighbours."""

import hashlib
import io
import math
import zlib

import numpy as np
import pytest

PAGE = """<!DOCTYPE html><html><head><title>T &am</title><style>p{}</style></head><body><nav><ul><li><a href="/x">the menu of the site</a></li></ul></nav>
<div class="ad">The best of the offers for you and all of them are here, by the makers of the things that you know and have had with you for long.</div>
<article><h1>Head&nbsp;line &amp; more</h1><p>It was the first of the days, and the people of the town had come to see what it was that they had been told of by the others, and by him.<br>Then
 it   ended.<p><script>var t="</p>";</script>Short one.</p><p>And so it is that the second of the parts has as many of the words that are in use by all of us at the time as the first had.</p>
<form><p>Sign in</p></form><aside>See also the others</aside></article><section id="comments"><p>I think that this is the best of all the things that you have had here, and it is as good as it was when you had the first.</p></section>
<footer>&copy; the site</footer></body></html>"""


def test_main_text():
    from weft.llm.html_extract import main_text

    assert main_text(PAGE).split("\n") == [
        "Head line & more",
        "It was the first of the days, and the people of the town had come to see what it was that they had been told of by the others, and by him. Then it ended.",
        "Short one.",
        "And so it is that the second of the parts has as many of the words that are in use by all of us at the time as the first had.",
    ]
    assert main_text(None) == main_text("") == main_text("<p></p><!-- x") == ""
    assert main_text("<article><p>Tiny.</p></article><footer>x") == "Tiny."


def test_extract_keeps_columns(spark):
    from weft.llm.html_extract import extract

    rows = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2)], "page_id long, url string, html string, block int")
    got = extract(rows).orderBy("page_id").collect()
    assert got[0]["n_chars"] == len(got[0]["text"]) > 100 and (got[1]["text"], got[1]["n_chars"], got[1]["block"]) == ("", 0, 2)
    assert extract(rows.limit(0)).count() == 0


def test_warc_round_trip(spark):
    from weft.llm.warc import read_archives, write_archives

    big, small = "ü" * 80 + "x\r\n\r\nWARC/1.1\r\n", "tiny"
    data = [(5, "u 5", big), (3, None, big), (9, "u9", big), (1, "u1", small), (2, "u2", small), (4, "u4", None), (6, "u6", "z" * 300000)]
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in data], "page_id long, url string, html string, digest string").repartition(3)
    got = {r["page_id"]: r for r in read_archives(write_archives(pages)).collect()}
    assert set(got) == {x[0] for x in data}
    for i, _, h in data:
        raw = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if i in (5, 9) else ("response", None))
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_normaliser_makes_members(tmp_path):
    from pyarrow import fs

    from weft.llm.warc import normalise, parse, read_index, read_record, record, split_records

    records = [record(i, f"http://x/{i}", b"p" * n, "d", n, None) for i, n in enumerate((0, 5, 200000))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.gz").write_bytes(z.compress(b"".join(records)) + z.flush())
    assert normalise(fs.LocalFileSystem(), str(tmp_path / "a.gz"), str(tmp_path / "b.gz")) == 3
    index = list(read_index(fs.LocalFileSystem(), str(tmp_path / "b.gz")))
    fields, block = read_record(str(tmp_path / "b.gz"), index[1][0])
    assert fields["WARC-Target-URI"] == "http://x/1" and block.endswith(b"ppppp") and read_record(str(tmp_path / "b.gz"), "none") is None
    raw = (tmp_path / "b.gz").read_bytes()
    assert [zlib.decompress(raw[o : o + n], 31) for _, o, n in index] == records
    assert len((tmp_path / "b.gz.idx").read_text().splitlines()) == 3
    assert parse(records[1])[0]["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        list(split_records(io.BytesIO(records[0][:-9])))


def test_warc_null_ids_and_repeated_rows(spark):
    from weft.llm.warc import read_archives, write_archives

    page = "p" * 150
    rows = [(None, "a", page), (4, "b", page), (4, "b", page), (8, None, page), (None, "c", "q" * 150), (None, "d", "small"), (9, "e", "z" * (3 << 20))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(2)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in read_archives(write_archives(pages)).collect())
    assert got == [(0, "response", 0, 5), (0, "response", 0, 150), (0, "revisit", 4, 150), (4, "response", 0, 150), (4, "response", 0, 150), (8, "revisit", 4, 150), (9, "response", 0, 3 << 20)]


def test_chi2_quantile():
    from weft.llm.ann import chi2_quantile

    assert math.isclose(chi2_quantile(0.95, 8), 15.507313, rel_tol=1e-6)


def test_neighbours(spark):
    from weft.llm.ann import nearest

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    x = centre[rng.integers(20, size=1500)] + rng.normal(0, 0.3, (1500, 16))
    x[7] = x[3]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [], 0), (2050, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = nearest(df, df.where("vec_id % 50 = 0"), k=5, block=400).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -2
        want = np.lexsort((np.arange(1500), -s))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r[2] - s[r[1]]) < 1e-12 for r in mine)
        hits += len({r[1] for r in mine} & set(want.tolist()))
    assert hits >= 0.95 * 150 and {r["query_id"] for r in got} == set(range(0, 1500, 50))
    few = nearest(df.where("vec_id < 3"), df.where("vec_id < 1"), k=5).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def verified_share(vectors, n):
    """(recall of five, share of all vectors that a query verified) against brute force."""
    from weft.llm.ann import searched

    rows = {r[0]: np.array(r[1], float) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = searched(vectors, vectors.where("vec_id % 50 = 0"), 5, block=n).collect()
    mine, seen, hits = {}, 0, 0
    for r in found:
        seen += r["verified"] or 0
        if r["vec_id"] is not None:
            mine.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    asks = [int(i) for i in ids if i % 50 == 0]
    for q in asks:
        s = unit @ unit[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -2
        hits += len({v for _, v in sorted(mine[q])[:5]} & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    return hits / 5 / len(asks), seen / len(asks) / len(ids)


def test_the_stop_spares_vectors(spark):
    plain = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    recall, share = verified_share(plain, 512)
    assert recall >= 0.9 and share < 0.6  # uniform directions: no structure to use
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 64))[rng.integers(40, size=2000)] + rng.normal(0, 0.2, (2000, 64))
    recall, share = verified_share(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 256)
    assert recall >= 0.9 and share < 0.1


def test_neighbours_of_extreme_and_repeated_vectors(spark):
    from weft.llm.ann import nearest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)) * 10.0 ** rng.choice([-170, 0, 160], 60)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 50 = 0"), k=5, block=16).collect()
    unit = [[v / m for v in r] for r in x.tolist() for m in [math.hypot(*r)]]
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), i) for i in range(60) if i != q)[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]
    # one vector in a third of all rows, repeated ids, and columns of the outputs' names
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist(), "own") for i in range(900)] + [(0, [3.0, 2.0, 1.0], "own"), (50, [1.0, 2.0, 3.0], "own"), (50, [1.0, 2.0, 3.0], "own")]
    hot = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest(hot, hot.where("vec_id % 50 = 0"), k=5, block=64).collect())
    assert [g[1] for g in got] == [1, 2, 3, 4, 5] * 18 and len({(g[0], g[2]) for g in got}) == 90
    assert [g[2] for g in got if g[0] == 50] == [1, 2, 4, 5, 7] and [g[2] for g in got if g[0] == 100] == [1, 2, 4, 5, 7]


def test_main_text_in_other_languages():
    from weft.llm.html_extract import main_text

    russian = "Вчера вечером жители города собрались на площади, чтобы обсудить новый мост через реку и дорогу к старому вокзалу. " * 2
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się na placu, żeby omówić nowy most przez rzekę oraz drogę. " * 2
    chinese = "昨天晚上市民们聚集在广场上讨论横跨河流的新桥以及通往旧火车站的道路。" * 5
    for body in (russian, polish, chinese):
        page = f"<html><body><div><a href='/'>{body[:90]}</a></div><div><h1>{body[:20]}</h1><p>{body}</p><p>{body[:80]}</p><p>{body}</p></div></body></html>"
        assert main_text(page).split("\n") == [body[:20].strip(), body.strip(), body[:80].strip(), body.strip()]


def test_main_text_in_marked_wrappers():
    from weft.llm.html_extract import main_text

    body = "It was the first of the days, and the people of the town had come to see what it was that they had been told of by the others, and by him, for the time."
    for mark in ("site has-sidebar", "no-sidebar", "content with-banner", "sidebar", "widget"):
        for tag in ("article", "main"):
            assert main_text(f"<body><div class='{mark}'><p>Near</p><{tag}><div class='entry-header'><h1>Head</h1></div><p>{body}</p></{tag}></div>").split("\n")[-2:] == ["Head", body]
    for mark in ("site-footer", "cookie-notice", "main-nav", "sidebar"):
        assert main_text(f"<body><article><p>{body}</p></article><div class='{mark}'><p>{body} No</p></div>") == body
    assert main_text(f"<body><article><p>{body}</p></article><div class='comments'><article><p>{body} No</p></article></div>") == body


def test_main_text_without_closing_tags():
    from weft.llm.html_extract import main_text

    body = "It was the first of the days, and the people of the town had come to see what it was that they had been told of by the others, and by him, for the time."
    head = "<html><head><meta charset='utf-8'><title>T</title><script>x('<div>')</script>"
    assert main_text(f"{head}<body><p>{body}</p>") == main_text(f"{head}<p>{body}</p>") == main_text(f"{head}{body}") == body
    assert main_text(f"{head}stray</head><body><p>{body}</p>") == body
    for cut in ("<svg width='1' />", "<math/>", "<svg><text>no</text></svg>", "<canvas>"):
        assert main_text(f"<article><p>{body}</p>{cut}<p>{body}</p></article><svg></svg>").split("\n") == [body, body]


def test_main_text_between_languages_and_links():
    from weft.llm.html_extract import main_text

    english = "It was the first of the days, and the people of the town had come to see what it was that they had been told of by the others, and by him, for the time."
    russian = "Вчера вечером жители города собрались на площади, чтобы обсудить новый мост через реку и дорогу к старому вокзалу. " * 2
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się na placu, żeby omówić nowy most przez rzekę oraz drogę. " * 2
    japanese = "昨夜、市民は広場に集まり、川に架かる新しい橋と古い駅への道について話し合った。" * 5
    for body in (russian, polish, japanese):
        assert main_text(f"<body><p>{body}</p><p>Short.</p><p>{body}</p></body>").split("\n") == [body.strip(), "Short.", body.strip()]
        assert main_text(f"<body><p>{english}</p><p>{body}</p><p>{english}</p></body>").split("\n") == [english, body.strip(), english]
    spaced = "&#32;&#x20;   \n\t" * 30
    linked = f"<article><p>{english}</p><p>A word of <a href='x'>{spaced}&lt;link&gt; text here{spaced}</a> in a line.</p><p>{english}</p></article>"
    assert main_text(linked).split("\n") == [english, "A word of <link> text here in a line.", english]
    for mark in ("market share", "social history", "a search for truth"):
        assert main_text(f"<body><p>{english}</p><p class='{mark}'>{english}</p></body>").split("\n") == [english] * 2
    for mark in ("share", "social share", "related-posts", "search-form", "comments", "share-buttons bottom", "site-notice"):
        assert main_text(f"<body><p>{english}</p><div class='{mark}'><p>{english}</p></div></body>") == english


def test_main_text_of_broken_pages_in_linear_time():
    import time

    from weft.llm.html_extract import main_text

    began = time.process_time()
    for unit in ("<a x", "<svg>", "<a '><b \"> ", '<a ">" ', "<!--", "</", "<script ", "<p class='x", "<", "&", "<p>"):
        main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 20
    began = time.process_time()
    assert main_text("<p>It is the end of it, and of the others as well.</p>" + "<a x" * 250_000) == "It is the end of it, and of the others as well."
    assert time.process_time() - began < 2
    body = "The whole of it was there for all of us to see, and it was as good as it had been before that day in the year that was the last of them. "
    assert main_text(f"<p class=\"x>{body}</p><p>{body}</p>").split("\n")[-1] == body.strip()
    assert main_text(f"<p>{body * 2000}</p>") == (body * 2000).strip()


def test_extract_on_repeats_and_clashing_columns(spark):
    from weft.llm.html_extract import extract

    rows = spark.createDataFrame([(1, "own", "<p>One line.</p>")] * 3 + [(2, None, None)], "page_id long, Text string, html string")
    got = extract(rows)
    assert got.columns == ["page_id", "html", "text", "n_chars"] and sorted((r["page_id"], r["text"]) for r in got.collect()) == [(1, "One line.")] * 3 + [(2, "")]


def test_main_text_equals_naive_two_passes():
    from weft.llm import html_extract as H

    def naive(found):
        """The rules block by block, in the order in which the module's docstring has them."""
        share = lambda b: sum(w.strip(".,;:!?\"'()") in H.STOP_WORDS for w in b.text.lower().split()) / len(b.text.split())
        flow = [b for b in found if not b.furniture]
        body = [b for b in flow if b.linked <= H.LINK_SHARE * len(b.text)]
        foreign = sum(len(b.text) * share(b) for b in body) < H.STOP_HIGH * sum(len(b.text) for b in body)
        inside = any(b.article for b in flow)

        def first(b):
            if b.linked > H.LINK_SHARE * len(b.text):
                return "doubt" if b.article and b.linked < H.WHOLLY * len(b.text) and H.SENTENCE.search(b.text) else "bad"
            if len(b.text) < H.SHORT or b.heading:
                return "short"
            if share(b) >= H.STOP_HIGH and len(b.text) >= H.LONG:
                return "good"
            if share(b) >= H.STOP_LOW or b.article:
                return "short"
            if foreign or 2 * len(H.BEYOND.findall(b.text)) > len(b.text):
                return "good" if len(b.text) >= H.LONG and not inside else "short"
            return "short" if H.SENTENCE.search(b.text) else "doubt"

        label = [first(b) for b in flow]
        out = []
        for i, b in enumerate(flow):
            kind = label[i]
            if kind in ("short", "doubt"):
                before = next((j for j in range(i - 1, -1, -1) if label[j] in ("good", "bad")), None)
                after = next((j for j in range(i + 1, len(flow)) if label[j] in ("good", "bad")), None)
                if kind == "doubt":
                    kind = "good" if before is not None and after is not None and label[before] == label[after] == "good" else "bad"
                elif "good" not in label:
                    kind = "good" if b.article or not inside else "bad"
                elif before is None or after is None:
                    kind = label[after if before is None else before]
                elif label[before] == label[after]:
                    kind = label[before]
                elif b.heading or b.article:
                    kind = "good"
                else:
                    kind = label[before] if i - before <= after - i else label[after]
            if kind == "good":
                out.append(b.text)
        return "\n".join(out)

    import random

    rng = random.Random(3)
    stop, rare = "the of and to in a is that for it".split(), "bridge harbour Lampe vista kolor źródło 町 река".split()
    for _ in range(300):
        page = ""
        for _ in range(rng.randint(1, 12)):
            words = " ".join(rng.choice(stop if rng.random() < rng.choice([0.0, 0.1, 0.4]) else rare) for _ in range(rng.choice([2, 8, 20, 40]))) + rng.choice([".", ""])
            tag = rng.choice(["p", "p", "p", "h2", "li", "div class='sidebar'", "footer", "article"])
            page += f"<{tag}>" + (f"<a href='#'>{words}</a>" if rng.random() < 0.2 else words) + f"</{tag.split()[0]}>"
        found = H.blocks(page)
        assert naive(found) == H.main_text(page)


LONG = "The harbour plan was discussed by the council and it was decided that the old pier will be rebuilt with the help of the city. " * 3


@pytest.mark.parametrize("page", ["<p class='" + "share " * 160_000 + "z!'>x</p>", "<p class='" + "share-" * 160_000 + "z!'>x</p>", "<div class=ad>x" * 65_000, "<div>" * 100_000 + "</x>" * 120_000, "<div class=ad>" * 33_000 + "<main></main>" * 38_000, "<div class=ad>" * 33_000 + "<article></article>" * 28_000])
def test_hostile_pages_take_linear_time(page):
    import time

    from weft.llm.html_extract import main_text

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10  # about a second


def test_a_form_around_the_page_is_no_furniture():
    from weft.llm.html_extract import main_text

    body = f"<div><p>{LONG}</p><p>{LONG}!</p></div>"
    want = f"{LONG.strip()}\n{LONG.strip()} !"
    assert main_text(f"<html><body><form id='aspnetForm'>{body}</form></body></html>") == want
    assert main_text(f"<html><body><form><div class='sidebar'><p>{LONG}</p></div>{body}</form></body></html>") == want
    assert main_text(f"<html><body>{body}<form><p>{LONG} Subscribe.</p></form></body></html>") == want
    assert main_text("<form><p>Name</p><input><p>Send</p></form>") == ""


@pytest.mark.parametrize("mark", ["class='user-comments'", "class='commentlist'", "class='comment-body'", "id='responses'", "class='comments post-1x comment_thread'", "id=respond"])
def test_reader_comments_are_left_out(mark):
    from weft.llm.html_extract import main_text

    assert main_text(f"<body><div><p>{LONG}</p></div><div {mark}><p>{LONG} I agree.</p></div></body>") == LONG.strip()


def test_names_that_only_sound_like_marks():
    from weft.llm.html_extract import marks

    assert not any(map(marks, ["", "commentary", "no-comments", "post comment-open", "heading", "sharebox x", "article-body", "ad-hoc-report", "-", "notices board", "download"]))
    assert all(map(marks, ["ads", "top-ad", "MENU2", "x main-nav", "share", "social share", "search-form", "related-posts", "comments", "nav_bar", "reader-comments x"]))


def test_blocks_that_speak_against_themselves_need_good_neighbours():
    from weft.llm.html_extract import main_text

    fruit = "Apples, pears, plums, cherries, quinces, medlars, grapes, figs, oranges, lemons, limes, dates, melons"
    see = "See <a href=x>the full report on the harbour plan here</a>."
    assert fruit in main_text(f"<p>{LONG}</p><p>{fruit}</p><p>{LONG}</p>") and fruit not in main_text(f"<p>{LONG}</p><p>{fruit}</p>")
    assert "full report" in main_text(f"<article><p>{LONG}</p><p>{see}</p><p>{LONG}</p></article>")
    assert "full report" not in main_text(f"<article><p>{LONG}</p><p>{see}</p></article>") and "full report" not in main_text(f"<article><p>{LONG}</p><p><a>The full report on the harbour.</a></p><p>{LONG}</p></article>")


def test_gif_walks_are_shared():
    import random
    import time

    from weft.llm.media import sniff

    def walked(m, at):
        """The published layout, block by block."""
        i = at + 13 + (3 << (m[at + 10] & 7) + 1 if len(m) > at + 10 and m[at + 10] & 128 else 0)
        while len(m) >= at + 13 and i < len(m):
            if m[i] == 0x3B:
                return i + 1 - at
            if m[i] == 0x21:
                i += 2
            elif m[i] == 0x2C and i + 10 <= len(m):
                i += 11 + (3 << (m[i + 9] & 7) + 1 if m[i + 9] & 128 else 0)
            else:
                return 0
            while i < len(m) and m[i]:
                i += 1 + m[i]
            i += 1
        return 0

    rng = random.Random(2)
    for _ in range(400):
        m = b"".join(rng.choice([b"GIF89a", b"GIF87a", b"\x2c" + bytes(9), b"\x21\xf9", b"\x3b", b"\0", bytes([rng.randrange(1, 9)] * 5), b"GIF89a" + bytes(4) + b"\0\0\0"]) for _ in range(rng.randrange(1, 40)))
        want = [(i, n, "image/gif") for i in range(len(m)) if m[i : i + 6] in (b"GIF87a", b"GIF89a") and (n := walked(m, i))]
        assert [x for x in sniff(m) if x[2] == "image/gif"] == want
    for m in ((b"GIF89aABCD\0AA,\1\1\1\1\1\1\1\1\1\1" + b"~" * 40) * 16_000, (b"GIF89aABCD\0AA!A" + b"\x7f" * 30) * 20_000):
        began = time.process_time()
        sniff(m)
        assert time.process_time() - began < 4  # a fraction of a second

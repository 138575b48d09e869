"""The SQL of the corpus operators gives their rows, on nulls, empty and long texts, ties and repeated rows too."""

import random

import pytest

duckdb = pytest.importorskip("duckdb")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("the of an era qué über ingot Zeta ο λόγος quick".split()) + str(rng.randrange(60)) for _ in range(n))
    passage = prose(70)
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A b  c d e", "é" * 260, "x " * 400, "\x0b".join("abcdefg"), passage, passage + " " + prose(20), prose(30) + passage[:-3] + "ß", prose(4000)]
    texts += [texts[-1][:9000] + " end", *(prose(rng.randint(1, 60)) for _ in range(30))]
    for t in texts[15:35]:
        words = t.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[13], (500, "", "en", "blank", 0), (501, None, None, "blank", None)]


def pages():
    long = "<p>" + "long ünïcode payload " * 9 + "</p>"
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", "a" * 99), (8, "u8", "a" * 99), (10, "u10", "b" * 100), (11, "u11", "b" * 100), (12, "u12", long + "!")]
    return [*rows, rows[0], rows[9]]


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", ["op3_warc", "op5_ngram_jaccard", "op9_source_mixing", "op10_suffix_dedup", "op12_ranked_search"])
def test_rows_equal_sql(spark, tmp_path, name, empty):
    from weft.llm import queries

    spark.createDataFrame([] if empty else documents(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else pages(), "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    items = [(1, "the quick ZETA era12"), (2, None), (3, "ß ο λόγος"), (1, "changed one"), (None, ".,")]
    spark.createDataFrame([] if empty else items, "item_id long, text string").repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    result = queries.queries()[name](spark, str(tmp_path))
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in result.select(*columns).collect())

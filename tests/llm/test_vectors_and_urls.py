from __future__ import annotations

from collections import Counter

import numpy as np
from llm_rows import SF_DIR, ready  # noqa: F401
from oracle import duck, duck_bag, spark_bag
from pyspark.sql import functions as F

from flotilla.llm import ball_tree, queries, url_filter


def test_top_k(ready):
    rnd = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rnd.integers(-9, 9, 6)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(9)] + [(50, rows[50][1]), (None, rows[3][1]), (999, None), (1000, []), (1050, []), (1100, [1, 2])]
    df = ready.createDataFrame(rows, "vec_id long, vector array<bigint>").withColumn("asks", F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
    found = ball_tree.top_k(df, F.col("asks"), shard_rows=40, query_rows=3)
    least = -(1 << 63)
    expected = Counter()
    for key, own in {(k, tuple(v)) for k, v in rows if k is not None and k % 50 == 0 and v is not None}:
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), least if k is None else k) for k, v in rows if v is not None and len(v) == len(own) and k != key)
        for rank, (score, other) in enumerate(scored[:5], 1):
            expected[key, rank, None if other == least else other, -score] += 1
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert ball_tree.top_k(df.limit(0), F.col("asks")).collect() == []


def test_usable(ready):
    df = ready.createDataFrame([(0, [0.5, -0.001]), (1, None), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, [])], "i int, e array<float>")
    found = {r.i: r.v for r in df.where(ball_tree.usable(F.col("e"))).select("i", ball_tree.quantised(F.col("e")).alias("v")).collect()}
    assert found == {0: [128, -1], 5: []}


def test_url_filter(ready):
    urls = ["http://Example.ORG/es/1", "https://m.example.org/en/12?x", "http://a.com/fr/x", "http://a.com/de/", "ftp://www.Bad.net/List/#top", "http://bad.net/list", "https://bad.net/List?y=1",
            "http://bad.net/List/", None, "no scheme", "http://", "x://h://y/z", "http://org/", "http://notexample.org/es/", "http://com/de/1", "http://bad.net/List\nmore", ""]
    pages = ready.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, w0 string")
    listed = ready.createDataFrame([("bad.net/List",), ("bad.net/List",), (None,), ("",), ("a.com/fr/x",)], "url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, listed).collect()}
    assert [found[i] for i in range(len(urls))] == [
        ("example.org", "/es/1", "example.org/es/", "block"), ("m.example.org", "/en/12", "example.org/en/1", "block"), ("a.com", "/fr/x", "com/fr/", "allow"),
        ("a.com", "/de/", "com/de/", "block"), ("www.bad.net", "/List/", None, "block"), ("bad.net", "/list", None, "allow"), ("bad.net", "/List", None, "block"), ("bad.net", "/List/", None, "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h:", "//y/z", None, "allow"), ("org", "/", "org/", "allow"), ("notexample.org", "/es/", "org/", "allow"),
        ("com", "/de/1", "com/de/", "block"), ("bad.net", "/List\nmore", None, "allow"), ("", "", None, "allow")]
    assert {r.verdict for r in url_filter.judged(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), listed).collect() == []


def test_no_false_negatives(ready):
    """With one bit a key nearly everything passes the filter, and the exact join still decides."""
    pages = ready.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), "id").alias("url"))
    listed = ready.range(0, 500, 7).select(F.concat(F.lit("h.net/"), "id").alias("url"))
    old, url_filter.BROADCAST_BYTES = url_filter.BROADCAST_BYTES, 0
    try:
        for bits in (1, 16):
            found = url_filter.judged(pages, listed, bits=bits).where("verdict = 'block'")
            assert sorted(r.page_id for r in found.collect()) == list(range(0, 500, 7))
    finally:
        url_filter.BROADCAST_BYTES = old


def test_queries_equal_sql(ready):
    con = duck(SF_DIR)
    for name, sql in queries.ORACLES.items():
        assert spark_bag(queries.QUERIES[name](ready, SF_DIR)) == duck_bag(con, sql), name


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))


def test_pipeline(ready):
    import corpus_pipeline

    out = corpus_pipeline.run(ready, SF_DIR)
    rows = out.collect()
    assert rows and all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    docs = ready.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "source mix", "token ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(ready, docs.limit(30), SF_DIR).columns == docs.columns

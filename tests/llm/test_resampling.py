"""Importance resampling against a plain computation."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest

from pneumaspark.llm import catalog, resampling

SF = "/root/testdata/sf0.001"


def features(text, max_run):
    w = [x for x in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower()) if x]
    return w, [b" ".join(w[k : k + n]) for n in range(1, max_run + 1) for k in range(len(w) - n + 1)]


def brute(docs, bench, n_buckets=10_000, max_run=1, seed=2024, least=20, percent=10):
    def count(texts):
        c = collections.Counter(zlib.crc32(f) % n_buckets for t in texts for f in features(t, max_run)[1])
        return c, sum(c.values())

    (s, all_s), (t, all_t) = count([d[1] for d in docs]), count(bench)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n_buckets) / ((s[b] + 1) * (all_t + n_buckets)))) for b in range(n_buckets)]
    out, pool = [], []
    for k, (i, text) in enumerate(docs):
        w, fs = features(text, max_run)
        weight = sum(gain[zlib.crc32(f) % n_buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(fs), weight, score, None])
        if len(w) >= least:
            pool.append((-score, i is not None, i or 0, len(fs), k))
    for rank, p in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        out[p[-1]][-1] = rank
    return sorted((tuple(r) for r in out), key=str)


def got(docs, bench, **how):
    return sorted([tuple(r) for r in resampling.resample(docs, bench, **how).collect()], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got(docs, bench) == want and sum(r[-1] is not None for r in want) > 10
    twin = duckdb.connect()
    for t in ("documents", "benchmark"):
        twin.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(twin.execute(catalog.oracle_sql()["op13_importance_resampling"]).fetchall(), key=str) == want


WORDS = " ".join(f"w{k}" for k in range(25))
ODD = [(1, None), (2, ""), (3, " .,- "), (4, WORDS), (4, WORDS), (4, WORDS + " more"), (None, WORDS), (None, "É é x"), (5, "A a a " * 30_000), (6, "日本 text\x00with\x1cseparators"), *[(k, WORDS + f" n{k % 3}") for k in range(7, 200)]]


@pytest.mark.parametrize("how", [{}, {"max_run": 2, "n_buckets": 97, "percent": 50, "seed": 7}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_odd_rows(spark, how):
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in ODD], "doc_id long, text string, score double, rank int").repartition(4)
    bench = spark.createDataFrame([("a", "w1 w2 É"), ("b", None)], "item_id string, text string")
    names = {"least_words": "least"}
    assert got(docs, bench, **how) == brute(ODD, ["w1 w2 É", None], **{names.get(k, k): v for k, v in how.items()})
    assert got(docs, bench.limit(0), **how) == brute(ODD, [], **{names.get(k, k): v for k, v in how.items()})
    assert got(docs.limit(0), bench, **how) == []


def test_ranks_go_on_across_blocks_of_one_score(spark):
    rows = [(k, 30, 0, 5 if k % 3 else 6, 30) for k in range(1000)] + [(2000, 3, 0, 9, 3)]
    ranks = {r.doc_id: r["rank"] for r in resampling.draw(spark.createDataFrame(rows, resampling.WEIGHED + ", n_words long"), percent=60).collect()}
    order = sorted(range(1000), key=lambda k: (k % 3 > 0, k))
    assert {k: ranks[k] for k in order[:600]} == {k: n for n, k in enumerate(order[:600], 1)}
    assert all(ranks[k] is None for k in [*order[600:], 2000])


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, WORDS + f" n{k}", "en") for k in range(50)], "doc_id long, text string, rank string")
    kept = resampling.drawn_documents(docs, docs.limit(3))
    assert kept.columns == docs.columns and kept.count() == 5

"""One pass tokenizes; scores come from the ids that it wrote."""

import collections

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pneumaspark.llm import lm_score
from pneumaspark.llm.common import WordEncoder


def test_gathered_ids_are_those_of_all_documents(spark):
    docs = [(k, f"Some words of document {k}, and {k % 3} more.") for k in range(60)] + [(None, "x"), (7, None), (8, "")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    numbered = documents.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = lm_score.gather(documents, held_out=True).where("kind <> 'word'").collect()
    encode = WordEncoder.of().encode
    want = {r.key: (lm_score.is_held_out(r.doc_id), np.frombuffer(encode((r.text or "").encode()), "<u4").tolist()) for r in numbered.collect()}
    assert {r.n: (r.kind == "held", np.frombuffer(r.key, lm_score.ID).tolist()) for r in rows} == want
    assert len(rows) == len(docs) and any(held for held, _ in want.values())


def test_rows_that_repeat_are_scored_once_each(spark):
    docs = spark.createDataFrame([(k % 5, f"the same words {k % 5}") for k in range(20)], "doc_id long, text string")
    rows = lm_score.lm_scores(docs).collect()
    assert len(rows) == 20 and len({(r.doc_id, r.score) for r in rows}) == 5


@pytest.mark.parametrize("skip", [0, 1, 8])
def test_states_from_a_place_on_are_the_last_of_all(skip):
    counts = np.abs(np.random.default_rng(3).standard_normal((2, 60))) + 1
    v = lm_score.Vocabulary(counts, np.arange(59) % 2)
    m = lm_score.Model(lm_score.Model.fresh(v), v.log_next)
    rows = np.random.default_rng(1).integers(0, v.begin, (9, lm_score.CONTEXT))
    assert np.allclose(m.states(rows, skip)[0], m.states(rows)[0][:, skip:], atol=1e-5)


def test_documents_are_read_twice_alone(spark):
    docs = spark.createDataFrame([(k, f"Some words of document {k}, {'seldom' * (k % 7)}{k} more.") for k in range(50)], "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = lm_score.lm_scores(docs.mapInArrow(seen, docs.schema)).collect()
    assert len(rows) == 50 and read.value == 100


def test_numbered_words_have_the_tokenizers_ids_and_whole_counts():
    texts = [" ".join(f"word{k * j % 37} Some, don't {j}é" for j in range(k)).lower().encode() for k in range(40)]
    train = [k % 3 > 0 for k in range(40)]
    numbers = lm_score.WordNumbers(WordEncoder(public_tokenizers.path("word_bpe_49k.json")), most=60)
    counts, coded, cleared = collections.Counter(), [], 0
    for at in range(0, 40, 8):
        if len(numbers.words) >= numbers.most:
            counts.update({w: int(n) for some, found in numbers.counted(7) for w, n in zip(some, found)})
            numbers.clear()
            cleared += 1
        coded += numbers.take([t.split() for t in texts[at : at + 8]], train[at : at + 8])
    counts.update({w: int(n) for some, found in numbers.counted(7) for w, n in zip(some, found)})
    assert cleared and counts == collections.Counter(w for t, use in zip(texts, train) if use for w in t.split())
    encode = WordEncoder.of().encode
    assert [np.frombuffer(c, lm_score.ID).tolist() for c in coded] == [np.frombuffer(encode(t), "<u4").tolist() for t in texts]

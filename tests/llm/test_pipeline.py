import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from covermap.llm.common import kept
from covermap.llm.decontamination import benchmark_leaks
from covermap.llm.mixing import plan_mix
from covermap.llm.queries import ORACLE_SQL, QUERIES
from covermap.llm.simhash import near_duplicates
from covermap.llm.token_ids import default_tokenizer
from covermap.llm.toxicity import toxic_scores

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of the last."""
    docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(kept(stage(spark, docs[-1], SF_DIR)))
    return docs


def firsts_by_brute_force(rows, texts, least):
    """The smallest id of each group, over links of fingerprints and of similar texts, compared pair by pair through shared shingles."""
    parent = {row.doc_id: row.component_id for row in rows}

    def top(node):
        while parent[node] != node:
            node = parent[node]
        return node

    sets = {doc_id: five_word_shingles(text) for doc_id, text in texts.items()}
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc_id)
    for doc_id, own in sets.items():
        common = Counter(other for shingle in own for other in holders[shingle] if other > doc_id)
        for other, count in common.items():
            if count >= least * (len(own) + len(sets[other]) - count):
                a, b = sorted((top(doc_id), top(other)))
                parent[b] = a
    return {doc_id for doc_id in parent if top(doc_id) == doc_id}


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def ids_of(df):
    return {row.doc_id for row in df.select("doc_id").collect()}


def test_stages_are_five_and_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "token-id output"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_each_stage_does_what_its_operator_says(spark, stages):
    documents, clean, single, uncontaminated, mixed, _ = stages
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert ids_of(clean) == ids_of(toxic_scores(documents, labels).where("predicted = 0"))
    # The stage drops all that op3_simhash drops, and texts of 0.8 or more in five-word shingles besides.
    first = ids_of(near_duplicates(clean).where("doc_id = component_id"))
    texts = {row.doc_id: row.text for row in clean.select("doc_id", "text").collect()}
    assert ids_of(single) <= first and single.count() == len(ids_of(single))
    assert ids_of(single) == firsts_by_brute_force(near_duplicates(clean).collect(), texts, corpus_pipeline.SIMILARITY)
    leaks = ids_of(benchmark_leaks(single, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")))
    assert ids_of(uncontaminated) == ids_of(single) - leaks and leaks
    times = {row.doc_id: row.times for row in plan_mix(uncontaminated).collect() if row.times}
    found = {}
    for row in mixed.select("doc_id").collect():
        found[row.doc_id] = found.get(row.doc_id, 0) + 1
    assert found == times


def test_the_files_hold_the_mix(stages):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    expected, start = [], 0
    for doc_id, text in sorted((row.doc_id, row.text) for row in stages[4].collect()):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == expected


def test_run_equals_its_stages(spark, stages, collected):
    assert collected(corpus_pipeline.run(spark, SF_DIR)) == collected(stages[-1])


def test_empty_documents(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF_DIR))
    assert docs.collect() == [] and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_all_are_registered():
    names = [name for name in driver.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert driver.queries()["pipeline"].__wrapped__ is corpus_pipeline.run and set(QUERIES) <= set(driver.queries())
    assert set(ORACLE_SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    from checks.compare import duckdb_rows, duckdb_tables, spark_rows
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == duckdb_rows(duckdb_tables(SF_DIR), ORACLE_SQL[name])

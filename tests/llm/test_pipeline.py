"""The pipeline's stages on small tables, each against what it must do."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from sievewright.llm.byte_bpe import TreeEncoder
from tests.llm.test_operators import brute_components, brute_contamination, brute_secrets, passage_family

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of every stage of a run over the smallest documents and a few odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(1001, None, "en", "s", 0), (1002, "", "en", "s", 0), (1003, "12 34", None, None, 5), (None, "the thing and that was for the of", "en", "s", 9)]
    rows, out = docs.unionByName(spark.createDataFrame(odd, SCHEMA)), {}
    out["documents"] = rows.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, rows, SF).write.parquet(path)
        rows = spark.read.parquet(path)
        out[name] = rows.collect()
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_language_stage_drops_only_texts_without_a_language(stages):
    gone = ids(stages["documents"]) - ids(stages["language_id"])
    assert {1001, 1002, 1003} <= gone and len(gone) <= 5
    before = {r.doc_id: r.lang for r in stages["documents"]}
    assert sum(before[r.doc_id] == r.lang for r in stages["language_id"]) >= 0.97 * len(stages["language_id"])


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    comp = brute_components([(r.doc_id, r.text) for r in stages["language_id"]], 5, 80)
    assert ids(stages["near_dedup"]) - {None} == set(comp.values())


def test_near_dedup_stage_on_a_family_that_shares_a_passage(spark):
    texts = passage_family(random.Random(11), 5, 600, [0.81, 0.84, 0.9] * 20)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    assert ids(corpus_pipeline.near_duplicates(spark, rows, SF).collect()) == set(brute_components(texts, 5, 80).values())


def test_decontamination_stage(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute_contamination([(r.doc_id, r.text) for r in stages["near_dedup"]], items, 13)
    assert ids(stages["decontaminate"]) == {w[0] for w in want if not w[5]}


def test_secret_stage_redacts_and_keeps_all(stages):
    assert ids(stages["secrets"]) == ids(stages["decontaminate"])
    assert not any(brute_secrets(r.text) for r in stages["secrets"])
    before = {r.doc_id: r.text for r in stages["decontaminate"]}
    clean = [r for r in stages["secrets"] if not brute_secrets(before[r.doc_id])]
    assert all(r.text == before[r.doc_id] for r in clean) and len(clean) > 100


def test_encoding_stage(stages):
    texts, tree = {r.doc_id: r.text for r in stages["secrets"]}, TreeEncoder()
    assert len(stages["byte_bpe"]) == len(stages["secrets"])
    for r in stages["byte_bpe"]:
        assert r.n_tokens == len(tree.encoding.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_tables_pass_through(spark):
    rows = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert out.count() == 0
        rows = out

"""Nulls, empty and long texts, repeated rows, clashing extra columns and empty tables."""
import re
import zlib
from collections import Counter

import pytest

from glazier.llm.queries import QUERIES

from llm_tables import BASE, DOCUMENTS, LONG, PAGES, TURNS, VECTORS


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


def test_sharding(spark, edge_dir):
    found = rows(spark, "op8_jump_sharding", edge_dir)
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in DOCUMENTS)
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    texts = {d[0]: d[1] or "" for d in DOCUMENTS}
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_fingerprints(spark, edge_dir):
    found = rows(spark, "op7_imatch_fingerprints", edge_dir)
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in DOCUMENTS)
    by = {r.doc_id: r for r in found}
    assert by[3].fingerprint == by[4].fingerprint and by[0].fingerprint == by[1].fingerprint
    assert by[5].fingerprint == by[7].fingerprint  # case is folded
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))


def test_packing(spark, edge_dir):
    found = rows(spark, "op9_ffd_packing", edge_dir)
    assert Counter(r.doc_id for r in found if r.start == 0) == Counter(d[0] for d in DOCUMENTS)
    assert next(r for r in found if r.doc_id == 0).doc_tokens == 1


def test_toxicity(spark, edge_dir):
    found = rows(spark, "op6_toxic_lexicon", edge_dir)
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in DOCUMENTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_token_counts(spark, edge_dir):
    found = rows(spark, "op2_trie_token_counts", edge_dir)
    words = {d[0]: len((d[1] or "").split()) for d in DOCUMENTS}
    assert len(found) == len(DOCUMENTS) and all(r.n_words == words[r.doc_id] <= r.n_tokens for r in found)


def test_mixing(spark, edge_dir):
    found = rows(spark, "op4_ipf_mixing", edge_dir)
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in DOCUMENTS)
    assert all(0 <= r.probability <= 1 and r.sampled in (True, False) for r in found)


def test_jaccard(spark, edge_dir):
    found = {r.doc_id: r for r in rows(spark, "op3_set_relation_join", edge_dir)}
    assert len(rows(spark, "op3_set_relation_join", edge_dir)) == len(DOCUMENTS)
    assert found[0].n_shingles == found[1].n_shingles == found[8].n_shingles == 0 and found[2].n_shingles == 1
    assert found[4].component_id == 3 and {found[i].component_id for i in (5, 6, 7)} == {5}
    assert found[8].component_id == 8 and found[None].component_id is None


def test_pages(spark, edge_dir):
    found = rows(spark, "op5_tag_path_ratios", edge_dir)
    assert len(found) == len(PAGES) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    assert by[0] == by[1] == by[5] == "" and by[2] == "just text & more"
    assert by[3] == "Head Main text, here. Two <b>." and len(by[None]) == len("long words, many. " * 20_000) - 1


def test_vectors(spark, edge_dir):
    found = rows(spark, "op10_e8_near_duplicates", edge_dir)
    assert len(found) == len(VECTORS) - 1  # an id given twice is one vector
    by = {r.vec_id: r for r in found}
    assert [by[i].n_links for i in (0, 1, 10)] == [2, 2, 2] and {by[i].component_id for i in (0, 1, 10)} == {0}
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (2, 3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert by[None].n_links == 0


def test_conversations(spark, edge_dir):
    from glazier.llm.common import read_table
    from glazier.llm.quotation_linking import link_conversations
    found = link_conversations(read_table(spark, edge_dir, "conversations")).collect()
    assert len(found) == len(TURNS) - 1
    by = {(r.conv_id, r.turn): r for r in found}
    assert [by[1, i].parent_turn for i in range(4)] == [None, 0, 1, 0]
    assert [by[1, i].reply_order for i in range(4)] == [0, 1, 2, 3] and by[1, 2].depth == 2 and by[1, 3].depth == 1
    assert by[1, 1].content == "Use sorted." and by[1, 2].content == "Thanks!"
    assert by[3, None].content == "hi" and by[3, None].n_linked == 0
    assert rows(spark, "op1_quotation_linking", edge_dir)


def test_pipeline(spark, edge_dir, empty_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, edge_dir)
        assert kept.columns == docs.columns
    kept = corpus_pipeline.STAGES[1][1](spark, docs, edge_dir).collect()
    assert Counter(r.doc_id for r in kept) == Counter([0, 1, 2, 3, 5, 8, 9, None, 2**62, -7])
    assert corpus_pipeline.run(spark, edge_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_fixture_texts():
    assert len(re.findall(r"\S+", LONG)) == 30_000 and len(BASE.split()) >= 20

from __future__ import annotations

import hashlib

import sentencepiece
from llm_samples import SF
from test_simhash import groups, plain_print
from test_substrings import plain_removal

import corpus_pipeline
from docsieve.llm.mixing import mix_sources
from docsieve.llm.quality import quality_rules
from docsieve.llm.queries import PIECES


def test_stages(spark, documents):
    """Each stage on what the one before it kept, against a plain version."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    good, first, cut, mixed, encoded = [f for _, f in corpus_pipeline.STAGES]
    one = good(spark, documents, SF).cache()
    assert one.dtypes == documents.dtypes
    kept = {r["doc_id"] for r in quality_rules(documents).where("kept").collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(kept)

    two = first(spark, one, SF).cache()
    assert two.dtypes == documents.dtypes
    prints = {r["doc_id"]: plain_print(r["text"]) for r in one.collect()}
    root, least = groups(prints.values(), 2), {}
    for key, p in sorted(prints.items()):
        least.setdefault(root[p], key)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(least.values())

    three = cut(spark, two, SF).cache()
    assert three.dtypes == documents.dtypes
    rows = two.collect()
    wanted = {r["doc_id"]: w for r, w in zip(rows, plain_removal([r["text"].encode() for r in rows], 400))}
    found = {r["doc_id"]: r for r in three.collect()}
    assert found.keys() == wanted.keys()
    for r in rows:
        size, gone, _, digest = wanted[r["doc_id"]]
        now = found[r["doc_id"]]
        assert now["n_chars"] == len(now["text"]) and now["source"] == r["source"]
        if not gone:
            assert now["text"] == r["text"]
        elif hashlib.sha256(now["text"].encode()).hexdigest() != digest:
            assert 0 < size - gone - len(now["text"].encode()) < 8

    four = mixed(spark, three, SF).cache()
    assert four.dtypes == documents.dtypes
    times = {r["doc_id"]: r["times"] for r in mix_sources(three).collect()}
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(k for k, n in times.items() for _ in range(n))

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    five = encoded(spark, four, SF).collect()
    assert len(five) == four.count()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_eos=True) for r in five)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty(spark, odd):
    """Nulls, empty and long texts, repeated ids, columns with clashing names, and no rows at all, through all stages."""
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert made.dtypes == docs.dtypes
                # The rules reject most of these texts, so the other stages see all of them.
                made.count()
            else:
                assert made.count() == docs.count()

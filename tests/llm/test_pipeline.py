"""The pipeline's rows on the smallest tables against a brute-force version of its stages."""

import re

import corpus_pipeline
from orrery.llm import toxicity
from orrery.llm.bpe_trie import tokenizer_path

from .brute import components, personal, shingles

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    left = sorted(r["doc_id"] for r in scores.collect() if r["score"] < 0.5)
    groups = {}
    for i in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", texts[i]), []).append(i)
    left = sorted(min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values())
    root = components({i: shingles(texts[i]) for i in left})
    left = [i for i in left if root[i] == i]
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(t.encode(personal(texts[i]), add_special_tokens=False).ids) + 1 for i in left}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "pii", "packing"]

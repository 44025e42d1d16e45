"""Candidates of near-duplicates against comparing all texts of a whole table with all."""

from orrery.llm import minhash

from .brute import shingles


def test_components_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    numbers: dict[tuple, int] = {}
    sets = {r["doc_id"]: {numbers.setdefault(s, len(numbers)) for s in shingles(r["text"] or "")} for r in docs.collect()}
    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if 75 * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert links > 50 and got == {i: top(i) for i in sets}

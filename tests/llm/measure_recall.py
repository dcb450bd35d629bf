"""Measures the near-copy join against exact Jaccard: ``python -m tests.llm.measure_recall /root/testdata/sf0.1``.

All pairs of different shingle sets at the threshold are found by prefix filtering: ordered
by how rare they are, two such sets share one of their first fifth of shingles.
"""

from __future__ import annotations

import collections
import sys


def exact_links(texts: dict[int, str], threshold: float = 0.8) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """(number of links of each document, pairs of smallest ids of different sets at the threshold)."""
    sets = collections.defaultdict(list)
    for i, text in texts.items():
        w = (text or "").encode().split()
        sets[frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])].append(i)
    rarity = collections.Counter(x for s in sets for x in s)
    index, pairs = collections.defaultdict(list), set()
    near = {s: 0 for s in sets}
    for s in sets:
        met = set()
        for x in sorted(s, key=lambda x: (rarity[x], x))[: len(s) - -(-int(threshold * 1000) * len(s) // 1000) + 1]:
            met.update(index[x])
            index[x].append(s)
        for other in met:
            if len(s & other) >= threshold * len(s | other) - 1e-9:
                pairs.add(tuple(sorted((min(sets[s]), min(sets[other])))))
                near[s] += len(sets[other])
                near[other] += len(sets[s])
    return {i: near[s] + len(ids) - 1 for s, ids in sets.items() for i in ids}, pairs


def main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession

    from token_ledger.llm.ngram_jaccard import ngram_jaccard_join

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    links, pairs = exact_links({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: r for r in ngram_jaccard_join(docs).collect()}
    found = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in pairs)
    print(f"pairs of different sets: {found} of {len(pairs)} in one class; links: {sum(r['links'] for r in got.values())} of {sum(links.values())}; rows whose links differ: {sum(got[i]['links'] != n for i, n in links.items())} of {len(links)}")


if __name__ == "__main__":
    main(sys.argv[1])

"""Regression packs: run a workload through all stages and report a hash of each stage's rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import evidence, retrieve
from tessera.plans.loop import Index, answer, search
from tessera.sources.store import content
from tessera.sources.workload import Workload, generate

#: Packs by name: documents, tokens, vocabulary, queries and seed.
PACKS = {
    "golden": Workload(docs=32, least_tokens=24, most_tokens=48, vocabulary=512, queries=16, query_tokens=6, seed=7),
    "turn_pairs": Workload(docs=16, least_tokens=20, most_tokens=40, vocabulary=256, queries=2, query_tokens=6, seed=9, tie_pair=False),
    "regression": Workload(docs=64, least_tokens=12, most_tokens=24, vocabulary=512, queries=16, query_tokens=6, seed=7),
}


def run(spark: SparkSession, workload: Workload, k: int = 16, seg_docs: int = 16) -> list[tuple[str, int, str]]:
    """(stage, rows, content hash) of ingest, index, search, evidence and answers."""
    docs, queries = generate(spark, workload)
    ix = Index.build(docs, seg_docs=seg_docs, source_col=None)
    kept = [x.persist() for x in (ix.rows, ix.postings, ix.segments)]
    policy = retrieve.Policy(max_hits=k)
    hits = search(ix, queries, policy)
    stages: dict[str, DataFrame] = {"documents": docs, "queries": queries, "rows": ix.rows, "postings": ix.postings, "segments": ix.segments, "hits": hits, "evidence": evidence.bundle(hits, k), "answers": answer(ix, queries, policy)}
    try:
        return [(name, *content(df)) for name, df in stages.items()]
    finally:
        for x in kept:
            x.unpersist()


def same(spark: SparkSession, workload: Workload, expected: str | None = None) -> str:
    """Runs a workload twice; fails if a stage differs, or if the pack's hash is not the expected one."""
    first, second = run(spark, workload), run(spark, workload)
    if first != second:
        raise AssertionError(f"stages differ: {[a[0] for a, b in zip(first, second) if a != b]}")
    pack = hashlib.sha256(repr(first).encode()).hexdigest()
    if expected and pack != expected:
        raise AssertionError(f"pack {pack} is not {expected}")
    return pack

"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from test_operators import brute_budgets, brute_fingerprint, library

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, shared = docs.columns, spark.conf.get("spark.checkpoint.dir")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = f"{shared}/test-stage-{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after = [r for r in docs.collect()]
        assert {r.doc_id for r in after} <= set(before), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(columns), name
        if "exact" in name:
            texts = {"".join(r.text.split()) for r in before.values()}
            assert len(after) == len(texts)
        if "near" in name:
            assert len({r.doc_id for r in after}) == len(after) <= len(before)
    assert len(after) == corpus_pipeline.run(spark, SF).count()


def test_run_against_a_plain_version(spark):
    from gridlore.llm import quality, registry

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    # The fit is held to a plain one by the operator's tests.
    model = quality.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    docs = [r.asDict() | {"text": r.text or ""} for r in table.collect()]
    docs = [d for d in docs if model.score(np.array([quality.statistics(d["text"])]))[0] >= corpus_pipeline.QUALITY_THRESHOLD]

    exact = defaultdict(list)
    for d in docs:
        exact[re.sub(r"[\x20\x09-\x0D]", "", d["text"])].append(d)
    docs = [min(g, key=lambda d: (-len(d["text"]), d["doc_id"])) for g in exact.values()]

    docs.sort(key=lambda d: d["doc_id"])
    prints = [brute_fingerprint(d["text"]) for d in docs]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            least = min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 2)
            changed, group[i] = changed or least < group[i], min(least, group[i])
    docs = [d for i, d in enumerate(docs) if group[i] == i]

    leaves = defaultdict(list)
    for d in docs:
        domain = next((n for n, known in registry.DOMAINS.items() if d["source"] in known), "other")
        leaves[domain, d["lang"], d["source"]].append((d, len(re.findall(r"[^ \t-\r]+", d["text"]))))
    sums = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = brute_budgets(sums, 1.5 * sum(sums.values()), 4, registry.TARGET_WEIGHTS, 0.8)
    mixed = []
    for leaf, members in leaves.items():
        whole, rest = divmod(int(budgets[leaf] + 1e-6), sums[leaf]) if sums[leaf] else (0, 0)

        def place(m, whole=whole):
            h = xxhash.xxh64_intdigest
            v = h(struct.pack("<q", m[0]["doc_id"]), h(struct.pack("<i", whole), h(struct.pack("<i", 7), 42)))
            return v - (1 << 64) if v >> 63 else v

        run = 0
        for d, n in sorted(members, key=place):
            run += n
            mixed += [d] * (whole + (run <= rest))

    lib = library("word_bpe_49k.json")
    want = []
    for d in mixed:
        ids = lib.encode(d["text"], add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(want) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from reelmark.session import cut_lineage
from tests.llm.test_op8 import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 345", "en", None, 6), (10**6 + 2, "only here are these words found", None, None, 31)]
    docs = given.select(*COLUMNS).unionByName(spark.createDataFrame(odd, SCHEMA))
    seen = [[tuple(r) for r in docs.collect()]]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut_lineage(stage(spark, now, ""))
        assert now.columns == COLUMNS
        seen.append([tuple(r) for r in now.collect()])
    start, spoken, single, mixed = seen
    assert {r[0] for r in start} - {r[0] for r in spoken} == {10**6, 10**6 + 1}
    assert all(r[2] for r in spoken)

    # Of linked documents the least id stays, and nothing that links with nothing goes.
    sets = {r[0]: shingles(r[1]) for r in spoken}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(r[0] for r in single) == sorted({root(i) for i in sets})
    assert max(Counter(r[0] for r in mixed).values()) <= 3 and {r[0] for r in mixed} <= {r[0] for r in single}

    pieces = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    total = sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in mixed)
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert sum(p["length"] for p in pieces) == total


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_stay_where_they_are(spark, tmp_path):
    rows = [(i, f"{i % 70} many other words follow this one {i % 70} here") for i in range(300)] + [(None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    stay = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plan = stay._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    kept = stay.collect()
    assert len(kept) == 72 and len({r["text"] for r in kept}) == 72

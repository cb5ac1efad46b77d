"""Packing beside its tokenizer, and the pipeline's stages."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pixelframe.llm import decontaminate, packing
from pixelframe.llm.common import documents, table
from edge_cases import edge_rows


def check(rows, texts, sizes=packing.SIZES):
    """Every id in one piece, sequences gapless and full; `texts` may hold an id more than once."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += len(ids)
    by_sequence, tokens = defaultdict(list), defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert tokens == {(d, n): sum(v for (e, m, _), v in want.items() if (e, m) == (d, n)) for d, n, _ in want}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sizes[0] and at & (at - 1) == 0 and {p.tier for p in pieces} == {at}
        assert len({p.step_group for p in pieces}) == 1
    whole = {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows if r.length == r.doc_tokens}
    assert whole <= set(want)
    return by_sequence


def test_packing_edges(edge, none):
    texts = [(d, t + " <|endoftext|>" if t else t) for d, t, *_ in edge_rows()]
    docs = edge.sparkSession.createDataFrame(texts, "doc_id long, text string").repartition(2)
    check(packing.pack(docs, packing.tokenizer_path()).collect(), texts)
    assert packing.pack(none, packing.tokenizer_path()).count() == 0


def test_packing_of_documents(spark, small):
    docs = documents(spark, small)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    check(rows, texts)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    assert all(zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)


def test_groups_hold_equal_tokens_and_even_cost():
    rng = np.random.default_rng(1)
    windows = [[[0, 0, int(a)], [1, 0, 1024 - int(a)]] for a in rng.integers(1, 1024, 160)]
    groups = packing.deal(windows, 1024)
    assert {len(g) for g in groups} == {16}
    cost = [sum(p[2] ** 2 for w in g for p in w) for g in groups]
    assert max(cost) < 1.02 * min(cost)


def test_stages(spark, small, tmp_path):
    docs = documents(spark, small)
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, before, small).write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "decontamination":
            assert decontaminate.matches(after, table(spark, small, "benchmark")).count() == 0
            assert 0 < after.count() < before.count()
        if name == "packing":
            check(after.collect(), [(r.doc_id, r.text) for r in before.collect()])
        before = after
    assert corpus_pipeline.run(spark, small).count() == before.count()


def test_stages_on_odd_documents(spark, small, edge, tmp_path):
    before = edge
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, small).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or after.columns == edge.columns
        before = after

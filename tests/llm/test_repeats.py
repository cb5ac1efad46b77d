"""Substring dedup, line dedup and near-duplicates beside brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pixelframe.llm import linedup, neardup, substrings
from pixelframe.llm.bytehash import mix
from pixelframe.llm.components import components
from pixelframe.llm.suffixsort import deep_shallow
from edge_cases import edge_rows, result


def test_deep_shallow_orders_and_classes():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)) + bytes(2000) + b"ab" * 500, np.uint8)
    starts = np.array(sorted(rng.sample(range(len(data) - 90), 1500)))
    lengths = np.array([rng.choice([20, 40, 41, 80]) for _ in starts])
    order, classes = deep_shallow(data, starts, lengths)
    text = data.tobytes()
    strings = [text[s:s + n] for s, n in zip(starts, lengths)]
    # Zero padding makes a string that continues with zero bytes tie with its prefix only inside the shallow part.
    assert [strings[i] for i in order] == sorted(strings)
    assert len(set(classes)) == len(set(strings))
    assert len(set(zip(classes, strings))) == len(set(strings))


def test_deep_shallow_empty():
    order, classes = deep_shallow(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(order) == len(classes) == 0


def substrings_by_hand(rows, length=50):
    first = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1 if doc_id is not None else 0):
            w = data[p:p + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = Counter()
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[p:p + length]] < doc_id:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[doc_id, len(data), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 20])
def test_substrings(edge, chunk_bytes):
    got = result(substrings.remove_repeats(edge, chunk_bytes=chunk_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substrings_by_hand(edge_rows())


def test_substrings_empty(none):
    assert substrings.remove_repeats(none).count() == 0


def lines_by_hand(rows):
    seen, out = {}, Counter()
    keyed = [(d, (t or "").split("\n")) for d, t, *_ in rows if t is not None and d is not None]
    for d, ls in keyed:
        for i in range(len(ls) - 2):
            w = tuple(ls[i:i + 3])
            if "".join(w).strip(" \t\r"):
                seen[w] = min(seen.get(w, (d, i)), (d, i))
    gone = {}
    for d, ls in keyed:
        for i in range(len(ls) - 2):
            w = tuple(ls[i:i + 3])
            if w in seen and seen[w] < (d, i):
                gone.setdefault((d, tuple(ls)), set()).update((i, i + 1, i + 2))
    for d, t, *_ in rows:
        ls = t.split("\n") if t is not None else []
        lost = gone.get((d, tuple(ls)), set()) if t is not None and d is not None else set()
        kept = "\n".join(x for i, x in enumerate(ls) if i not in lost) if t is not None else None
        out[d, len(ls), kept] += 1
    return out


def test_lines(edge):
    a = edge.where("doc_id = 6").first()["text"]  # texts under one id that share no line with each other
    kept = "\n".join(f"keep{i}" for i in range(6))
    more = [(6, a), (200, "x\n" + a), (200, kept), (200, kept + "\n" + a), (201, kept)]
    rows = [*edge_rows(), *((d, t, "en", "a", len(t)) for d, t in more)]
    docs = edge.unionByName(edge.sparkSession.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert result(linedup.line_dedup(docs), "doc_id", "n_lines", "kept_text") == lines_by_hand(rows)
    again = linedup.without_repeats(docs)
    assert again.columns == docs.columns
    assert result(again, "doc_id", "text") == Counter((d, t) for d, _, t in lines_by_hand(rows).elements())


def test_lines_empty(none):
    assert linedup.line_dedup(none).count() == 0


def test_lines_sql(edge):
    docs = edge.where("doc_id between 0 and 6 or doc_id > 7").select("doc_id", "text").dropDuplicates().toPandas()  # noqa: F841
    with duckdb.connect() as con:
        con.register("documents", docs)
        want = con.sql(linedup.ORACLE).fetchall()
    got = linedup.line_dedup(edge.sparkSession.createDataFrame(docs, "doc_id long, text string"))
    assert result(got, "doc_id", "n_lines", "n_removed", "kept_text") == Counter(want)


def groups_by_hand(rows, percent=85):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(d, []).append(s)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(d, s) for d, ss in sets.items() for s in ss if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if 100 * len(s & t) >= percent * len(s | t) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return Counter((d, len(s), find(d), d is None or find(d) == d) for d, ss in sets.items() for s in ss)


def test_near_duplicates(edge):
    got = result(neardup.near_duplicates(edge), "doc_id", "n_shingles", "component_id", "kept")
    assert got == groups_by_hand(edge_rows())
    assert neardup.one_of_each(edge).columns == edge.columns


def test_near_duplicates_chain(spark):
    """Each text differs a little from the one before: links that do not pass through the bucket's smallest."""
    rng, words, rows = random.Random(5), [f"w{i}" for i in range(300)], []
    order = list(range(1000, 1040))
    rng.shuffle(order)
    for k, doc_id in enumerate(order):
        words[k * 7 % 300] = f"new{k}"
        rows.append((doc_id, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got, "doc_id", "n_shingles", "component_id", "kept") == groups_by_hand(rows)


def test_pipeline_stage_links_from_80_percent(spark):
    """The stage keeps what brute force at 80 percent keeps; some pairs lie between 0.80 and 0.85."""
    rng, rows = random.Random(11), []
    for k in range(12):
        words = [f"g{k}w{i}" for i in range(200)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for i in rng.sample(range(5, 195, 6), rng.choice([1, 3, 4, 5, 7])):
                copy[i] = f"new{k}x{j}x{i}"
            rows.append((10 * k + j, " ".join(copy)))
    kept = {p: {d for d, _, _, first in groups_by_hand(rows, p) if first} for p in (80, 85)}
    assert kept[80] < kept[85]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept[80]


def test_near_duplicates_empty(none):
    assert neardup.near_duplicates(none).count() == 0


def test_superminhash_is_unbiased_and_varies_less():
    rng = np.random.default_rng(2)
    for n in (5, 60, 500):
        found = []
        for _ in range(120):
            items = np.sort(mix(rng.integers(1, 1 << 60, 2 * n).astype(np.uint64)))
            sig = neardup.signatures([items[:int(1.5 * n)], items[int(0.5 * n):]])
            found.append((sig[0] == sig[1]).mean())
        true = len(range(int(0.5 * n), int(1.5 * n))) / (2 * n)
        bound = (true * (1 - true) / neardup.PLACES) ** 0.5
        assert abs(np.mean(found) - true) < 4 * bound / 120 ** 0.5
        assert np.std(found) < bound * 1.15 and (n > 5 or np.std(found) < 0.9 * bound)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(1000, x) for x in range(1001, 1200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert result(got, "node", "root") == Counter((x, find(x)) for x in root if find(x) != x)


def test_components_of_links_between_members(spark):
    """Nodes that get a root from each of two tasks: 2-7, 7-9, 3-9 with 7 and 9 in different tasks."""
    edges = [(10 * k + a, 10 * k + b) for k in range(40) for a, b in ((2, 7), (7, 9), (3, 9))]
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(16))
        assert result(got, "node", "root") == Counter((10 * k + x, 10 * k + 2) for k in range(40) for x in (3, 7, 9))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

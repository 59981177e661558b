"""Registered queries against SQL, brute force or held-out labels."""
import hashlib
import zlib

import brute
import numpy as np
import oracle_compare
import pytest

import corpus_pipeline
from stepscope.llm import packing
from stepscope.llm.queries import QUERIES, table
from stepscope.llm.oracle import SQL

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(spark, sf, name, *columns):
    return [tuple(r) for r in table(spark, sf, name).select(*columns).orderBy(columns[0]).collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_statement(spark, name):
    assert oracle_compare.difference(QUERIES[name](spark, TINY), oracle_compare.connect(TINY), SQL[name]) is None


def test_substring_dedup_equals_brute_force(spark):
    expected = {doc: (n, n - len(kept.split()), hashlib.sha256(kept.encode()).hexdigest())
                for doc, n, kept in brute.windows_removed(rows_of(spark, SMALL, "documents", "doc_id", "text"))}
    got = QUERIES["op4_lempel_ziv"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expected and len(got) == len(expected)


def test_shingle_classes_equal_brute_force(spark):
    rows = rows_of(spark, SMALL, "documents", "doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_prefix_join"](spark, SMALL).collect()}
    expected = brute.shingle_classes(rows)
    assert got == {doc: (len(brute.shingles(text)), expected[doc]) for doc, text in rows}


def test_nearest_neighbours_recall(spark):
    rows = rows_of(spark, SMALL, "embeddings", "vec_id", "embedding")
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op1_multi_index"](spark, SMALL).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == [i for i in ids if i % 100 == 0]
    hits = 0
    for query, ranked in found.items():
        far = np.linalg.norm(x - x[ids == query], axis=1)
        near = [i for i in ids[np.lexsort((ids, far))] if i != query][:10]
        assert sorted(ranked) == list(range(1, 11))
        assert all(abs(far[ids == v][0] - s) < 1e-12 for v, s in ranked.values())
        assert [s for _, (_, s) in sorted(ranked.items())] == sorted(s for _, s in ranked.values())
        hits += len({v for v, _ in ranked.values()} & set(near))
    assert hits >= 0.9 * 10 * len(found)


def test_vector_classes_equal_brute_force(spark):
    rows = rows_of(spark, "/root/testdata/sf0.1", "embeddings", "vec_id", "embedding")
    copies = [(10_000 + i, [v * (1 + 0.1 * (k % 3)) for k, v in enumerate(rows[i % 7][1])]) for i in range(40)] + [(20_000 + i, rows[3][1]) for i in range(30)]
    rows += copies
    from stepscope.llm.cover_tree import dedup
    got = {r.vec_id: r for r in dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    norm, ids = np.linalg.norm(x, axis=1), [r[0] for r in rows]
    close = x @ x.T / norm[:, None] / norm[None] >= 0.9
    np.fill_diagonal(close, False)
    expected = brute.classes(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close))])
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ids} == {
        i: (int(n), expected[i], expected[i] == i) for i, n in zip(ids, close.sum(axis=1))}


def test_packing_is_lossless_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows_of(spark, SMALL, "documents", "doc_id", "text")
    ids = {doc: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for doc, text in rows}
    pieces = QUERIES["op5_packing"](spark, SMALL).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for parts, total in [(sorted(v), len(ids[d])) for d, v in by_doc.items()] + [(sorted(v), None) for v in by_sequence.values()]:
        end = 0
        for start, length in parts:
            assert start == end and length > 0
            end += length
        assert end == total if total is not None else end <= packing.WINDOW
    ends = [sum(n for _, n in v) for v in by_sequence.values()]
    assert sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in ends) <= packing.MOST_SLACK * len(ends)


@pytest.mark.parametrize("name, label, auc", [("op9_toxicity", "toxic", 0.9), ("op10_quality", "quality", 0.97)])
def test_held_out_ranking(spark, name, label, auc):
    truth = dict(rows_of(spark, "/root/testdata/sf0.1", "labels", "doc_id", label))
    scored = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    folds, held = (5, 0) if label == "toxic" else (4, 2)
    assert len(scored) == 10_000 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in scored)
    assert all(r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.7)) for r in scored)
    held_out = sorted((r.score, truth[r.doc_id]) for r in scored if r.held_out and truth.get(r.doc_id) in (0, 1))
    ones = sum(y for _, y in held_out)
    ranks = sum(k + 1 for k, (_, y) in enumerate(held_out) if y)
    assert (ranks - ones * (ones + 1) / 2) / (ones * (len(held_out) - ones)) >= auc


def test_pipeline_stages(spark):
    """Every stage's own decision, against a plain version over what its predecessor kept."""
    docs, kept = table(spark, TINY, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, TINY)
        kept.append([r.asDict() for r in result.collect()])
        if name == "near_duplicates":
            before = {r["doc_id"]: r["text"] for r in kept[-2]}
            expected = brute.shingle_classes(sorted(before.items()))
            assert sorted(r["doc_id"] for r in kept[-1]) == sorted(d for d, c in expected.items() if c == d)
        if name != "packing":
            assert result.dtypes == docs.dtypes
            docs = spark.createDataFrame(kept[-1], docs.schema)
    raw = {r["doc_id"] for r in [r.asDict() for r in table(spark, TINY, "documents").collect()]}
    assert {r["doc_id"] for r in kept[0]} < raw and {r["doc_id"] for r in kept[2]} == {r["doc_id"] for r in kept[1]}
    copies = {}
    for r in kept[3]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    pieces = {}
    for p in kept[4]:
        pieces[p["doc_id"]] = pieces.get(p["doc_id"], 0) + p["length"]
    assert set(pieces) == set(copies)


def test_pipeline_run_ends_in_pieces(spark):
    assert corpus_pipeline.run(spark, TINY).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_pipeline_returns_the_packed_ids(spark):
    """The redacted texts can be read from the last stage's result, with digests of the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "x AKIA" + "B" * 12 + " y", 20), (2, "plain", 5)], "doc_id bigint, text string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    pieces = stages["packing"](spark, stages["secrets"](spark, docs, TINY), TINY).collect()
    assert all(len(p.ids) == 4 * p.length and p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        found.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert {doc: tokenizer.decode(ids[:-1]) for doc, ids in found.items()} == {1: "x [secret] y", 2: "plain"}


def test_token_matrix_query_holds_every_document(spark):
    """Segments of the query's rows lie side by side and cover each document once, with the ids of the tokenizer."""
    rows = rows_of(spark, TINY, "documents", "doc_id", "text")
    lengths = {doc: len(packing.token_ids(text, "byte_bpe_50k")) for doc, text in rows}
    got, covered = QUERIES["op7_token_matrix"](spark, TINY).collect(), {}
    for r in got:
        assert r.cu_seqlens[0] == 0 and r.n_tokens == r.cu_seqlens[-1] <= 2048 and r.position_resets == r.cu_seqlens[:-1]
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            covered.setdefault(doc, []).append((start, start + b - a))
    for doc, spans in covered.items():
        spans.sort()
        assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == lengths[doc]
    assert set(covered) == set(lengths) and len({r.sequence_id for r in got}) == len(got)

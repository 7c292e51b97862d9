"""The pipeline, stage by stage, against plain versions of its stages."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import mixing, quality
from shelfmark.llm.catalog import KEEP_FROM, table
from shelfmark.llm.common import store, text_runs
from tests.llm import brute
from tests.llm.test_brute_force import check_packing

SF = "/root/testdata/sf0.01"


def plain_quality(rows, labels):
    known = {r.doc_id: r.quality for r in labels}
    learn = [(quality_of, text) for k, text in rows if (quality_of := known.get(k)) is not None and crc(k) % 5]
    slots = [s.astype(np.int32) for _, run in text_runs([t for _, t in learn]) for s in quality.features(run)]
    order = sorted(range(len(learn)), key=lambda i: (learn[i][0], slots[i].tobytes()))
    model = quality.train([slots[i] for i in order], np.array([learn[i][0] for i in order]))
    kept = []
    for start, run in text_runs([t for _, t in rows]):
        for (key, _), s in zip(rows[start:start + len(run)], quality.features(run)):
            margin = model["product"][s].sum(dtype=np.float64) / np.sqrt(model["square"][s].sum(dtype=np.float64)) + model["bias"]
            if 1 / (1 + np.exp(-(model["slope"] * margin + model["offset"]))) >= KEEP_FROM:
                kept.append(key)
    return set(kept)


def crc(key):
    import zlib

    return zlib.crc32(str(key).encode())


@pytest.mark.parametrize("seed", [0])
def test_stages_and_run(spark, seed):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    columns = docs.columns
    expected = None
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        done = store(stage(spark, docs, SF), "stage-test")
        if name == "pack_sequences":
            pieces = done.collect()
            assert check_packing(pieces, before) == 0
            expected = {(r.doc_id, r.start, r.length) for r in pieces}
            break
        after = {r.doc_id: r.text for r in done.collect()}
        assert done.columns == columns and done.count() == len(after)
        if name == "quality_classifier":
            assert set(after) == plain_quality(before, labels.collect())
            good = {r.doc_id: r.quality for r in labels.collect()}
            assert all(k in after for k, _ in before if good.get(k) == 1)
        elif name == "line_dedup":
            assert after == brute.without_lines(before, 8)
        elif name == "minhash_near_dedup":
            assert set(after) == {k for k, (_, c) in brute.near_components(before, 80).items() if k == c}
        else:
            con = duckdb.connect()
            rows = docs.toPandas()
            con.register("documents", rows)
            assert set(after) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.mix_sql()}) WHERE kept").fetchall()}
        docs = done
    got = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {g[0] for g in got} == {e[0] for e in expected}

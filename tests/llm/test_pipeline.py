from __future__ import annotations

import hashlib

import public_tokenizers

import corpus_pipeline
from airlume.llm.bpe import vocabulary
from airlume.llm.queries import ORACLES, QUERIES
from test_decontaminate import _plain as plain_hits
from test_exact import _plain as plain_exact
from test_simhash import _plain_components, _plain_print

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    rows = {r.doc_id: r for r in given}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(list(rows.values()), docs.schema), SF)
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        assert all(rows[i] == r for i, r in kept.items())
        pairs = [(i, r.text) for i, r in rows.items()]
        if name == "exact dedup":
            assert set(kept) == {i for i, _, _, stays, _ in plain_exact(pairs) if stays}
        elif name == "simhash near-dedup":
            classes = _plain_components({i: _plain_print(t or "") for i, t in pairs})
            assert set(kept) == set(classes.values())
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept) == {i for i, n, hit, _ in plain_hits(pairs, items) if not (hit and 20 * hit >= n)}
        # So few documents need not hold near copies that are not exact ones.
        assert 0 < len(kept) < len(rows) or name == "simhash near-dedup", name
        rows = kept
    encoding, _ = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {i: (encoding.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for i, r in rows.items()}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]

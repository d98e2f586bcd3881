"""Each stage of the pipeline against a plain version of it on the stage's own input."""

import zlib

import numpy as np
import pytest

pytest.importorskip("copse.llm")

import corpus_pipeline  # noqa: E402
from test_operators import ODD, WORD, components_by_hand, documents, fingerprint_by_hand, hits_by_hand, targets_by_hand  # noqa: E402

from copse.llm.queries import TOKENIZER, vocabulary_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    tok = Tokenizer.from_file(vocabulary_path(TOKENIZER))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if k < 4:
            assert docs.columns == COLUMNS
        ids = sorted(r["doc_id"] for r in after)
        if name == "language":
            assert ids == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif name == "near_duplicates":
            assert ids == sorted(set(components_by_hand({r["doc_id"]: fingerprint_by_hand(r["text"]) for r in before}).values()))
        elif name == "decontamination":
            assert ids == sorted(x[0] for x in hits_by_hand([(r["doc_id"], r["text"]) for r in before], items) if not x[-1])
        elif name == "mixing":
            size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            target = targets_by_hand({s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())})
            assert set(ids) <= set(size) and max(ids.count(i) for i in set(ids)) <= 2
            for s, want in target.items():  # to half of a document at either end of the part taken
                longest = max(n for i, n in size.items() if source[i] == s)
                assert abs(sum(size[i] for i in ids if source[i] == s) - want) <= longest
        else:
            want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in before)
            assert sorted((r["doc_id"], r["ids_crc32"]) for r in after) == want


def test_stages_on_odd_rows(spark, sf_dir):
    """Null, empty, repeated and very long rows, extra columns: each stage's rows by hand."""
    odd = documents(spark, [*ODD, (8, "words of a document that stays as it is", "en", "b")])
    model_rows = documents(spark, [(100 + k, "the quick brown fox and the lazy dog", "en", "b") for k in range(3)])
    docs = odd.unionByName(model_rows)
    want = {
        "language": [None, 3, 3, 4, 5, 6, 8, 100, 101, 102],
        "near_duplicates": [None, 3, 5, 6, 8, 100],
        "decontamination": [None, 3, 5, 6, 8, 100],
    }
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert docs.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is not None, i or 0))
        if name in want:
            assert ids == want[name], name
        else:
            assert set(ids) <= {None, 3, 5, 6, 8, 100}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.limit(0).select(*COLUMNS), sf_dir)
        assert none.count() == 0 and (name == "tokens" or none.columns == COLUMNS)

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from test_jaccard import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import common, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality.fit(docs, labels, common.crc_mod("doc_id", 3) != 1)
    good = {r["doc_id"] for r in quality.scored(docs, model).filter("score >= 0.5").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    owner = {}
    for doc_id, text in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        owner.setdefault((text or "").encode().translate(None, common.SPACE), (doc_id, text))
    kept = [r for r in owner.values()]
    kept = [r for r, c in zip(sorted(kept), near_brute([(*r, 0, 0) for r in sorted(kept)])) if r[0] in {x[2] for x in near_brute([(*r, 0, 0) for r in kept])}]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for doc_id, text in kept:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) - (-(-len(ids) // 2048) - 1) * 2048, len(ids) + 1, 2048)]
        want |= {(doc_id, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = common.materialize(out, "test")
    assert docs.count() > 0


def test_empty_documents(spark):
    docs = common.table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), "test")
    assert docs.count() == 0 and docs.agg(F.count("doc_id")).first()[0] == 0


def test_edge_rows_through_every_stage(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with dots and names used inside."""
    prose = [r["text"] for r in common.table(spark, SF, "documents").join(common.table(spark, SF, "labels"), "doc_id").filter("quality = 1").orderBy("doc_id").limit(6).collect()]
    long_ = " ".join(prose) * 40
    rows = [
        (1, prose[0], "en", None, 1, "x", 1),
        (2, prose[0] + " \n", "en", "a", 2, None, None),  # a copy with more code points
        (3, prose[1], None, "a", 3, "x", 1),
        (3, prose[1], None, "a", 3, "x", 1),  # a repeated row
        (4, prose[1] + " tail", "en", "a", 4, "x", 1),  # a near copy
        (5, long_, "en", "a", None, "x", 1),
        (None, prose[2], "en", "a", 5, "x", 1),
        (None, None, None, None, None, None, None),
        (6, "", "en", "a", 0, "x", 1),
        (7, prose[3], "en", "a", 6, "x", 1),
        (8, prose[3], "en", "a", 6, "x", 1),  # a tie
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, gid int")
    model = quality.fit(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"), common.crc_mod("doc_id", 3) != 1)
    scores = model.scores(pa.array([r[1] or "" for r in rows]))
    want = Counter(r for r, s in zip(rows, scores) if s >= 0.5)
    good = common.materialize(quality.keep_good(docs, model), "test")
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == want
    exact = common.materialize(corpus_pipeline.STAGES[1][1](spark, docs, SF), "test")
    kept = list(map(tuple, exact.collect()))
    assert exact.columns == docs.columns and len(kept) == 7
    assert {(r[0], r[1]) for r in kept} == {(2, rows[1][1]), (3, prose[1]), (4, rows[4][1]), (5, long_), (None, prose[2]), (6, ""), (7, prose[3])}
    near = common.materialize(corpus_pipeline.STAGES[2][1](spark, exact, SF), "test")
    assert near.columns == docs.columns and Counter(map(tuple, near.collect())) == Counter(r for r in kept if r[0] != 4)
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), corpus_pipeline.STAGES[3][1](spark, near, SF).collect()
    lengths = Counter()
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {r[0]: len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in kept if r[0] != 4}

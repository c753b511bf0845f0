"""The registered queries over the smallest tables, against brute force or SQL."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_chat import brute as chat_brute
from test_jaccard import brute as near_brute
from test_lm import brute_scores
from tokenizers import Tokenizer

import __spark_entry__
from folio.llm import queries

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encode(name, docs):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([text for _, text in docs], add_special_tokens=False)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.execute(queries.ORACLES[name]).df()
    found = __spark_entry__.queries()[name](spark, SF).toPandas()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(found.columns) == sorted(wanted.columns) and key(found) == key(wanted[found.columns])


def test_op1(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert {r["conv_id"]: tuple(r)[1:5] for r in run(spark, "op1_chat_windows")} == chat_brute(rows)


def test_op5(spark, docs):
    start, want = 0, []
    for (doc_id, _), ids in zip(docs, encode("word_bpe_49k.json", docs)):
        want.append((doc_id, start, len(ids) + 1, crc(ids + [1])))
        start += len(ids) + 1
    assert sorted(map(tuple, run(spark, "op5_token_shards"))) == want


def test_op6(spark, docs):
    assert sorted(map(tuple, run(spark, "op6_jaccard_join")), key=repr) == near_brute([(*d, 0, 0) for d in docs])


def test_op7(spark, docs):
    want = set()
    for (doc_id, _), ids in zip(docs, encode("byte_bpe_50k.json", docs)):
        ids = ids + [0]
        cuts = [0, *range(len(ids) - (-(-len(ids) // 2048) - 1) * 2048, len(ids) + 1, 2048)]
        want |= {(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = run(spark, "op7_best_fit_packing")
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_op8(spark, docs):
    got = run(spark, "op8_quality_votes")
    assert sorted(r["doc_id"] for r in got) == [d for d, _ in docs]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d, len(ids), crc(ids), True) for (d, _), ids in zip(docs, library.encode([t for _, t in docs]))]
    assert sorted(map(tuple, run(spark, "op9_sentence_pieces"))) == want


def test_op10(spark, docs):
    want = brute_scores([(d, t, zlib.crc32(str(d).encode()) % 7 == 2) for d, t in docs])
    for g, w in zip(sorted(map(tuple, run(spark, "op10_backoff_lm"))), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)

"""The pipeline against the plain versions of its stages, on planted documents."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm.common import written
from vitrine.llm.line_chunks import REACH, RULES
from test_decontam import plain_matches
from test_line_chunks import plain_rules
from test_simhash import plain_components, plain_fingerprint

public_tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    vocab = np.array([f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "lo", "mu", "ne") for b in ("r", "st", "ving", "tion", "le", "sha", "pod")])

    def line(n=9):
        return " ".join(rng.choice(vocab, n)).capitalize() + "."

    prose = lambda k: "\n".join(line(int(rng.integers(6, 12))) for _ in range(k))
    items = [(k, " ".join(line(8) for _ in range(3))) for k in range(6)]
    rows, toxic = {}, set()
    for i in range(160):
        rows[i] = prose(int(rng.integers(4, 14)))
        if i % 4 == 1:
            words = rows[i].split(" ")
            for w in rng.permutation(["blockhead", "numbskull", "dunderhead"]):
                words.insert(int(rng.integers(0, len(words))), str(w))
            rows[i] = " ".join(words)
            toxic.add(i)
    boiler = prose(9)
    for i in (8, 40, 72):
        rows[i] += "\n" + boiler
    rows |= {200: rows[12], 201: rows[12], 202: rows[16] + "\nOne more line here.", 203: "", 204: None, 205: "single words only", 206: "single words only"}
    for i, k in ((20, 0), (24, 1), (28, 2)):
        rows[i] += "\n" + items[k][1].upper()
    labels = [(i, 1, int(i in toxic)) for i in range(160)] + [(None, 1, 0), (12, None, None)]
    return rows, labels, items, toxic


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items, _ = corpus()
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()]
    docs.append(docs[4])  # a repeated row
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_in_order_and_their_columns(spark, sf):
    rows, _, items, toxic = corpus()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    want = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "toxicity":
            want = {i: t for i, t in want.items() if i not in toxic}
        elif name == "line_dedup":
            plain = plain_rules({i: t or "" for i, t in want.items()}, RULES, REACH)
            want = {i: None if t is None else plain[i][0] for i, t in want.items()}
            assert want[200] == "" and any(x[2] for i, x in plain.items() if i < 100)
        elif name == "simhash_near_dedup":
            comp = plain_components(list(want), [plain_fingerprint(t) for t in want.values()])
            want = {i: t for i, t in want.items() if comp[i] == i}
            assert 205 in want and 206 not in want and 201 not in want
        else:
            held = {d for d, _ in plain_matches(items, list(want.items()), 0.5, 0.8)}
            want = {i: t for i, t in want.items() if i not in held}
            assert held >= {20, 24, 28}
        got = texts(out)
        assert got == want, name
        docs = written(out, "test")  # as the contract has it: stages read what was written
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    lib = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert final.keys() == want.keys()
    for i, t in want.items():
        ids = lib.encode(t or "")
        r = final[i]
        assert (r["ids"], r["n_tokens"], r["span_bytes"]) == (ids, len(ids), len((t or "").encode()))
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg(F.count(F.lit(1))).first()[0] == 0 and "ids" in out.columns

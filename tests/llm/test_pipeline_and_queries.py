"""The pipeline's stages against plain versions, and every query with an SQL twin against DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[2] / "tools")]

import corpus_pipeline as p  # noqa: E402
from check_oracle import connect, differences  # noqa: E402

from tallywork.llm.queries import ORACLE, QUERIES, documents_network  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


def test_stages(spark):
    import public_tokenizers as P

    from test_dedup import plain_classes, plain_lines
    from test_license_mixing import plain_share
    from tallywork.llm import byte_bpe, quality_model

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    stage = dict(p.STAGES)
    good = stage["quality classifier"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    net = documents_network(spark, FOLDER)
    want = {i for i, r in rows.items() if net.score(r["text"]) >= 0.3}
    assert {r["doc_id"] for r in good.collect()} == want

    lines = stage["line dedup"](spark, good, FOLDER)
    plain = plain_lines([(i, rows[i]["source"], rows[i]["text"]) for i in want], 10)
    got = {r["doc_id"]: r for r in lines.collect()}
    assert {i: r["text"] for i, r in got.items()} == plain and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert lines.columns == docs.columns

    single = stage["n-gram Jaccard join"](spark, lines, FOLDER)
    kept = sorted(str(r["doc_id"]) for r in single.collect())
    assert kept == sorted({c for _, c, _ in plain_classes(list(plain.items()))}) and single.columns == docs.columns

    mixed = stage["mixing sources"](spark, single, FOLDER)
    assert mixed.columns == docs.columns
    totals = {}
    for r in single.collect():
        domain = ("web", "books", "forums")[int(r["source"][3:]) % 3]
        totals[domain] = totals.get(domain, 0) + len(r["text"].split())
    shares = plain_share({d: (2 * t, {"web": 5, "books": 3, "forums": 2}[d]) for d, t in totals.items()}, sum(totals.values()))
    longest = max(len(r["text"].split()) for r in single.collect())
    sums = {}
    for r in mixed.collect():
        domain = ("web", "books", "forums")[int(r["source"][3:]) % 3]
        sums[domain] = sums.get(domain, 0) + len(r["text"].split())
    leaves = single.select("source", "lang").distinct().count()
    for d, budget in shares.items():
        assert budget - leaves <= sums[d] <= budget + leaves * longest

    encoding = byte_bpe.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    encoded = stage["byte-level BPE"](spark, mixed, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(encoded) == mixed.count() and all(r["round_trip"] for r in encoded)
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(texts[r["doc_id"]])) for r in encoded)
    assert quality_model.WIDTH // 2 == quality_model.STRIDE


def test_stages_on_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, epoch string, html string"
    edge = spark.createDataFrame([
        (1, None, None, None, None, "s", "e", "h"), (2, "", "en", "src1", 0, "s", "e", "h"), (2, "", "en", "src1", 0, "s", "e", "h"),
        (None, "a text without id", "en", "other", 17, "s", "e", "h"), (4, "long words here " * 9000, "en", "src2", 0, None, None, None)], schema)
    for docs in (edge, edge.limit(0)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
        assert all(r["round_trip"] for r in docs.collect())


def test_run(spark):
    got = p.run(spark, FOLDER)
    assert got.count() > 0 and got.filter("NOT round_trip").count() == 0

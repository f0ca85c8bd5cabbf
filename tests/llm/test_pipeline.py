"""The pipeline against its stages' brute-force versions, and its queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from leaserisk.llm.queries import ORACLES, QUERIES
from tools.check import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(list(rel.columns), rel.fetchall())[0]


def test_entry_registers_all():
    names = E.queries()
    assert {n for n in QUERIES} | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_pass_documents_on(spark):
    from leaserisk.llm.text import read

    from .test_bpe_packing import valid_sequences
    from .test_simhash_pivot import brute_components, brute_print
    from .test_suffix_dedup import brute

    docs = read(spark, SF, "documents")
    columns = docs.columns
    kept = {n: f for n, f in corpus_pipeline.STAGES}
    good = kept["quality classifier"](spark, docs, SF).cache()
    assert good.columns == columns and 0 < good.count() <= docs.count()
    one = kept["SimHash near-dedup"](spark, good, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    ids = sorted(rows)
    roots = brute_components([brute_print(rows[i]) for i in ids], ids, 4)
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(set(roots))
    cut = kept["suffix-array dedup"](spark, one, SF).cache()
    before = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {i: w for (i, _), w in zip(before, brute([t for _, t in before], 200))}
    assert cut.columns == columns
    for r in cut.collect():
        assert (len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]) and r["n_chars"] == len(r["text"])
    clean = kept["secret scans"](spark, cut, SF).cache()
    assert clean.columns == columns and clean.count() == cut.count()
    packed = kept["best-fit packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()} and valid_sequences(packed, 1024)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)

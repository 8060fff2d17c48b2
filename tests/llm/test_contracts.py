"""The columns that each query of the contract returns, over the smallest tables."""

import pytest

from tallybook.llm import queries

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_host_reputation": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_differencing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_robust_outliers": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_suffix_windows": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_segmentations": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_private_spans": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_size_aware_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_piece_agenda": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_rotated_codes": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_small_worlds": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}
PER_ROW = {"op1": "pages", "op4": "documents", "op5": "documents", "op6": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op11": "embeddings", "op12": "documents"}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = queries.QUERIES[name](spark, ROOT)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    table = PER_ROW.get(name.split("_")[0])
    if table:
        assert found.count() == spark.read.parquet(f"{ROOT}/{table}.parquet").count()

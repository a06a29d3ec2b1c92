"""Every operator and stage takes tables with further columns, whatever their names, and with nulls in any of them."""

import public_tokenizers
import pytest

import corpus_pipeline
from rosterlake.llm import byte_bpe, collocations, filter_audit, flac, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, token_files, url_filters, warc

NAMES = ("path", "known", "range", "digest", "failed", "length", "rank", "before", "version", "key", "kept", "copies", "n_equal", "own", "turn", "copy", "size", "shard", "node", "label", "spans", "ids", "media", "n_words", "scores", "part", "check", "host", "payload")


@pytest.fixture(scope="module")
def wide(spark, odd_rows):
    rows = [(*r, *(None if (k + n) % 5 == 0 else f"{name}{k % 3}" for n, name in enumerate(NAMES))) for k, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0, "x") for k in range(100, 140)] + [(None, None, None, None)], "doc_id long, quality int, toxic int, key string")


def plain(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


OPERATORS = {
    "op1": lambda docs, labels: substring_dedup.remove_repeats(docs),
    "op2": lambda docs, labels: byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op3": lambda docs, labels: quality_rules.judge(docs, labels),
    "op5": lambda docs, labels: token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 1).drop("start"),
    "op6": lambda docs, labels: flac.from_media(flac.to_media(docs)),
    "op7": lambda docs, labels: ngram_join.join(docs),
    "op8": lambda docs, labels: warc.round_trip(docs.withColumnsRenamed({"doc_id": "page_id", "lang": "url", "text": "html"})),
    "op9": lambda docs, labels: url_filters.judge(docs.withColumnsRenamed({"doc_id": "page_id", "text": "url"})),
    "op10": lambda docs, labels: sharding.shard(docs),
    "op11": lambda docs, labels: collocations.collocations(docs, least=5),
    "op12": lambda docs, labels: filter_audit.audit(filter_audit.failures(docs, labels)),
    "op13": lambda docs, labels: packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1).select("doc_id", "start", "length", "doc_tokens"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_change_nothing(wide, labels, name):
    assert rows(OPERATORS[name](wide, labels)) == rows(OPERATORS[name](plain(wide), labels))


def test_mixing_takes_all_rows(wide):
    """Rows are known by all of their columns here, so only what is exact is compared."""
    found, other = mixing.mix(wide), mixing.mix(plain(wide))
    same = ("doc_id", "size", "source_size", "target")
    assert rows(found.select(*same)) == rows(other.select(*same))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_return_the_columns_of_their_input(spark, wide, labels, tmp_path, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    found = stage(spark, wide, str(tmp_path))
    assert found.columns == wide.columns
    held = set(map(str, (tuple(r) for r in wide.drop("text", "n_chars").collect())))
    assert set(map(str, (tuple(r) for r in found.drop("text", "n_chars").collect()))) <= held
    assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0

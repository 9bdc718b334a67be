"""Every operator on tables with extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from helixframe.llm import (
    ann, chat, decontaminate, filter_audit, html, licenses, line_dedup, ngram_join, packing, sharding, toxicity, warc, whitening,
)
from helixframe.llm.catalog import tokenizer_path

NAMES = ["_id", "_tid", "_h", "_part", "rank", "node", "_id0", "n", "root", "grp", "row", "key", "size", "slot", "component", "hash", "pos", "_row", "score", "part", "mask"]


def read(spark, small, name, more):
    df = spark.read.parquet(f"{small}/{name}.parquet")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)]) if more else df


def archives(spark, small, more, folder):
    warc.write_archives(read(spark, small, "pages", more), folder)
    return warc.read_archives(spark, folder, payload=False).select("record_id", "payload_bytes", "payload_digest", "record_type")


def toxic(spark, small, more, folder):
    docs = read(spark, small, "documents", more)
    model = toxicity.fit(docs, read(spark, small, "labels", more))
    return toxicity.drop_toxic(docs, *model).select("doc_id").union(toxicity.score_documents(docs, *model).select((F.col("predicted") - 10).cast("long")))


CASES = {
    "warc": archives,
    "packing": lambda s, d, m, f: packing.pack_documents(read(s, d, "documents", m), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "sharding": lambda s, d, m, f: sharding.shard_documents(read(s, d, "documents", m), 24).select("doc_id", "shard", "slot"),
    "ann": lambda s, d, m, f: ann.nearest(read(s, d, "embeddings", m), F.col("vec_id") % 50 == 0, 5).select("query_id", "rank", "vec_id"),
    "decontaminate": lambda s, d, m, f: decontaminate.find_contamination(read(s, d, "documents", m), read(s, d, "benchmark", m)),
    "drop_contaminated": lambda s, d, m, f: decontaminate.drop_contaminated(read(s, d, "documents", m), read(s, d, "benchmark", m)).select("doc_id"),
    "chat": lambda s, d, m, f: chat.read_back(chat.format_conversations(read(s, d, "conversations", m))),
    "ngram_join": lambda s, d, m, f: ngram_join.link_components(read(s, d, "documents", m)),
    "keep_one": lambda s, d, m, f: ngram_join.keep_one(read(s, d, "documents", m).union(read(s, d, "documents", m).limit(3))).select("doc_id", "text"),
    "licenses": lambda s, d, m, f: licenses.scan_licenses(read(s, d, "documents", m)).select("doc_id", "n_words", "n_base", "labels"),
    "html": lambda s, d, m, f: html.extract_main_text(read(s, d, "pages", m)),
    "toxicity": toxic,
    "filter_audit": lambda s, d, m, f: filter_audit.audit_filters(read(s, d, "documents", m), read(s, d, "labels", m)),
    "whitening": lambda s, d, m, f: whitening.whiten_embeddings(read(s, d, "embeddings", m)).select("vec_id", "component", "n", "deviation"),
    "line_dedup": lambda s, d, m, f: line_dedup.dedup_lines(read(s, d, "documents", m)).select("doc_id", "text", "n_lines", "n_dropped"),
}


@pytest.mark.parametrize("name", CASES)
def test_extra_columns_change_nothing(spark, small, tmp_path, name):
    plain, more = (sorted(map(str, CASES[name](spark, small, m, f"{tmp_path}/{m}").collect())) for m in (False, True))
    assert plain and plain == more

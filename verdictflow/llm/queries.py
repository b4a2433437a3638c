"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact, licenses, packing, passages, quality, secrets, sharding, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_quality_rules": quality.op2,
    "op3_bpe": bpe.op3,
    "op4_packing": packing.op4,
    "op5_simhash": simhash.op5,
    "op6_byte_shards": sharding.op6,
    "op7_secrets": secrets.op7,
    "op8_passages": passages.op8,
    "op9_licenses": licenses.op9,
    "op10_exact_dedup": exact.op10,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_quality_rules": quality.SQL,
    "op6_byte_shards": sharding.SQL,
    "op7_secrets": secrets.SQL,
    "op10_exact_dedup": exact.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

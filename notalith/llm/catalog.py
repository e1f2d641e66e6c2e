"""The queries of the corpus operators and the SQL that their results are held against."""

from __future__ import annotations

from . import bpe, dedup, langid, ngram_join, packing, pii, secrets, sharding, topk, warc


def queries() -> dict:
    found = [warc.op1_warc, ngram_join.op2_ngram_join, dedup.op3_exact_dedup, sharding.op4_sharding, langid.op5_language_id, bpe.op6_bpe, topk.op7_topk, secrets.op8_secrets, pii.op9_pii, packing.op10_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL, "op3_exact_dedup": dedup.OP3_SQL, "op7_topk": topk.OP7_SQL}

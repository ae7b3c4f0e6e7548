"""The ten queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import bpe, embeddings, langid, mixing, secrets, simhash, suffix, topk, toxicity, warc

QUERIES = {
    "op1_suffix": suffix.op1_suffix,
    "op2_secrets": secrets.op2_secrets,
    "op3_langid": langid.op3_langid,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_warc": warc.op5_warc,
    "op6_topk": topk.op6_topk,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe": bpe.op9_bpe,
    "op10_simhash": simhash.op10_simhash,
}
SQL = {"op2_secrets": secrets.OP2_SQL, "op4_embeddings": embeddings.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_topk": topk.OP6_SQL, "op8_mixing": mixing.OP8_SQL}

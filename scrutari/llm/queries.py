"""Queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from . import ann, bpe, decontaminate, langid, licences, minhash, pii, sharding, toxicity, transcripts

QUERIES = {
    "op1_langid": langid.query,
    "op2_ann": ann.query,
    "op3_toxicity": toxicity.query,
    "op4_chat": transcripts.query,
    "op5_licences": licences.query,
    "op6_sharding": sharding.query,
    "op7_decontamination": decontaminate.query,
    "op8_pii": pii.query,
    "op9_bpe": bpe.query,
    "op10_minhash_dedup": minhash.query,
}

SQL = {"op5_licences": licences.SQL, "op6_sharding": sharding.SQL, "op7_decontamination": decontaminate.SQL}

"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, decontam, fim, langid, mixing, phrases, pii, quality, secrets, sharding, simhash, topk, warc


def queries():
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_personal_data": pii.op3_personal_data,
        "op4_quality": quality.op4_quality,
        "op5_shards": sharding.op5_shards,
        "op6_warc_round_trip": warc.op6_warc_round_trip,
        "op7_simhash_components": simhash.op7_simhash_components,
        "op8_language_id": langid.op8_language_id,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_top_k": topk.op10_top_k,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_collocations": phrases.op12_collocations,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql():
    return {"op2_mix_sources": mixing.OP2_SQL, "op6_warc_round_trip": warc.OP6_SQL, "op10_top_k": topk.OP10_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_collocations": phrases.OP12_SQL}

"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (alignment, ann, decontam, langid, lexical, mixing, neardup, packing, secrets, sharding, surrogates,
               urlrep, warc)

QUERIES = {
    "op1_surrogates": surrogates.op1_surrogates,
    "op10_nearest": ann.op10_nearest,
    "op4_mixing": mixing.op4_mixing,
    "op6_warc": warc.op6_warc,
    "op2_language": langid.op2_language,
    "op5_minhash": neardup.op5_minhash,
    "op3_sharding": sharding.op3_sharding,
    "op7_secrets": secrets.op7_secrets,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_host_reputation": urlrep.op9_host_reputation,
    "op11_lexical": lexical.op11_lexical,
    "op12_packing": packing.op12_packing,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op6_warc": warc.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op9_host_reputation": urlrep.oracle(),
    "op11_lexical": lexical.ORACLE,
}

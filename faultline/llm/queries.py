"""Queries of this package and their SQL twins, added to the catalog when the package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import bytebpe, collocations, decontaminate, language, maintext, maxscore, ppm, quality, repair
from faultline.llm import repeats, secrets, setjoin, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repeats": repeats.op1_suffix_repeats,
    "op2_best_fit": sharding.op2_best_fit,
    "op3_maxscore": maxscore.op3_maxscore,
    "op4_boosted_nodes": maintext.op4_boosted_nodes,
    "op5_winnowing": decontaminate.op5_winnowing,
    "op6_ppm": ppm.op6_ppm,
    "op7_entropy_secrets": secrets.op7_entropy_secrets,
    "op8_language_id": language.op8_language_id,
    "op9_byte_bpe": bytebpe.op9_byte_bpe,
    "op10_partenum": setjoin.op10_partenum,
    "op11_additive_pairs": quality.op11_additive_pairs,
    "op12_audit_repair": repair.op12_audit_repair,
    "op13_setm_phrases": collocations.op13_setm_phrases,
}
SQL: dict[str, str] = {
    "op3_maxscore": maxscore.OP3_SQL,
    "op12_audit_repair": repair.OP12_SQL,
    "op13_setm_phrases": collocations.OP13_SQL,
}

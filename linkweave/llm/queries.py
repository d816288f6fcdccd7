"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from linkweave.llm import decontaminate, language_model, packing, quality, secrets, sharding, simhash, substring_dedup, token_stream, warc_zip

QUERIES: dict[str, Callable] = {
    "op1_decontamination": decontaminate.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_warc": warc_zip.query,
    "op4_simhash": simhash.query,
    "op5_packing": packing.query,
    "op6_sharding": sharding.query,
    "op7_lm_scoring": language_model.query,
    "op8_token_stream": token_stream.query,
    "op9_secret_scan": secrets.query,
    "op10_quality_rules": quality.query,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.SQL,
    "op3_warc": warc_zip.SQL,
    "op6_sharding": sharding.SQL,
    "op10_quality_rules": quality.SQL,
}

"""The queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from lodestock.llm.ann import op5_ivfpq_neighbours
from lodestock.llm.dac import op1_token_codes
from lodestock.llm.mixing import op3_mix_sources
from lodestock.llm.ogg import op7_ogg_media
from lodestock.llm.packing import op8_pack_sequences
from lodestock.llm.quality import op9_quality_ordinal
from lodestock.llm.secrets import op2_secret_scan
from lodestock.llm.simhash import op10_simhash_gray
from lodestock.llm.suffixes import op4_suffix_dedup
from lodestock.llm.warc import op6_warc_archives


def queries() -> dict:
    ops = (op1_token_codes, op2_secret_scan, op3_mix_sources, op4_suffix_dedup, op5_ivfpq_neighbours, op6_warc_archives, op7_ogg_media, op8_pack_sequences, op9_quality_ordinal, op10_simhash_gray)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}

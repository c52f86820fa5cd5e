"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from .bpe import op4_bpe
from .decontam import OP8_SQL, op8_decontamination
from .langid import op6_langid
from .line_dedup import OP7_SQL, op7_line_dedup
from .mil_quality import op5_quality
from .quality_rules import op3_quality_rules
from .sharding import op10_sharding
from .simhash import op9_simhash
from .toxicity import op2_toxicity
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": OP7_SQL,
    "op8_decontamination": OP8_SQL,
}

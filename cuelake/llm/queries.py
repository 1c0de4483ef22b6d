"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op4_chat
from .decontam import ORACLE_SQL as DECONTAM_SQL
from .decontam import op10_decontamination
from .fim import ORACLE_SQL as FIM_SQL
from .fim import op13_fim
from .html_text import op12_html_text
from .licences import op6_licences
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op3_line_dedup
from .packing import op9_packing
from .pii import op1_pii
from .quality import op2_quality
from .quality_rules import op5_quality_rules
from .repair import op11_repair
from .simhash import op7_simhash
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat": op4_chat,
    "op5_quality_rules": op5_quality_rules,
    "op6_licences": op6_licences,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_repair": op11_repair,
    "op12_html_text": op12_html_text,
    "op13_fim": op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP_SQL,
    "op8_warc": WARC_SQL,
    "op10_decontamination": DECONTAM_SQL,
    "op13_fim": FIM_SQL,
}

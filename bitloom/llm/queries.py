"""The registered queries of this subpackage and the SQL that states the same result."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .decontamination import op2_decontamination
from .fill_middle import OP13_SQL, op13_fill_middle
from .html_extraction import op5_html_extraction
from .packing import op1_packing
from .phrases import OP12_SQL, op12_phrases
from .pii import op8_pii
from .quality_rules import op3_quality_rules
from .secret_scan import op10_secret_scan
from .simhash import op4_simhash
from .token_files import op7_token_files
from .toxicity import op6_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_phrases": op12_phrases,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {"op9_warc": OP9_SQL, "op12_phrases": OP12_SQL, "op13_fill_middle": OP13_SQL}

"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit
from .audit import op13_filter_audit
from .bpe import op5_token_counts
from .decontaminate import op3_decontamination
from .html import op10_html
from .licenses import op4_licenses
from .periodic import op11_periodic_runs
from .pieces import op6_sentencepiece
from .pii import op1_pii
from .simhash import op2_simhash
from .suffix import op9_suffix
from .toxicity import op8_toxicity
from .webp import op7_media
from .windows import op12_word_windows

FOUND = (
    op1_pii, op2_simhash, op3_decontamination, op4_licenses, op5_token_counts, op6_sentencepiece, op7_media, op8_toxicity, op9_suffix, op10_html,
    op11_periodic_runs, op12_word_windows, op13_filter_audit,
)
QUERIES = {f.__name__: f for f in FOUND}
ORACLES: dict[str, str] = {"op13_filter_audit": audit.ORACLE}

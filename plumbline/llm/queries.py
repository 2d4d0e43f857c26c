"""The registered queries of this subpackage, each over its whole table, and DuckDB SQL where it fits."""

from __future__ import annotations

from .byte_bpe import op5_byte_bpe
from .decontamination import OP8_SQL, op8_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .html_text import op2_html_text
from .language import op6_language
from .licenses import OP4_SQL, op4_licenses
from .near_duplicates import OP9_SQL, op9_near_duplicates
from .ngram_join import OP12_SQL, op12_ngram_join
from .periodic_runs import op11_periodic_runs
from .quality_classifier import op1_quality_classifier
from .quality_rules import op7_quality_rules
from .suffix_tree import op10_suffix_tree
from .token_files import op3_token_files

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_html_text,
        op3_token_files,
        op4_licenses,
        op5_byte_bpe,
        op6_language,
        op7_quality_rules,
        op8_decontamination,
        op9_near_duplicates,
        op10_suffix_tree,
        op11_periodic_runs,
        op12_ngram_join,
        op13_filter_audit,
    )
}
ORACLE = {
    "op4_licenses": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op12_ngram_join": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}

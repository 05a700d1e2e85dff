"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_middle, hamming_search, langid, line_dedup, mixing, packing, repeat_dedup, shingle_join, token_alignment, toxicity, url_filter, vector_dedup
from .common import table


def queries() -> dict:
    return {
        "op1_hamming_search": lambda s, d: hamming_search.op1(table(s, d, "embeddings")),
        "op2_shingle_join": lambda s, d: shingle_join.op2(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.op3(table(s, d, "documents"), table(s, d, "labels")),
        "op4_repeat_dedup": lambda s, d: repeat_dedup.op4(table(s, d, "documents")),
        "op5_vector_dedup": lambda s, d: vector_dedup.op5(table(s, d, "embeddings")),
        "op6_packing": lambda s, d: packing.op6(table(s, d, "documents")),
        "op7_language": lambda s, d: langid.op7(table(s, d, "documents")),
        "op8_url_filter": lambda s, d: url_filter.op8(table(s, d, "pages")),
        "op9_line_dedup": lambda s, d: line_dedup.op9(table(s, d, "documents")),
        "op10_mixing": lambda s, d: mixing.op10(table(s, d, "documents")),
        "op11_exact_dedup": lambda s, d: exact_dedup.op11(table(s, d, "documents")),
        "op12_token_alignment": lambda s, d: token_alignment.op12(table(s, d, "documents")),
        "op13_fill_middle": lambda s, d: fill_middle.op13(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hamming_search": hamming_search.OP1_SQL,
        "op2_shingle_join": shingle_join.OP2_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_exact_dedup": exact_dedup.OP11_SQL,
        "op13_fill_middle": fill_middle.OP13_SQL,
    }

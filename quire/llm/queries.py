"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bitslice, decontaminate, hosts, huffman, langid, lines, ngram_lm, packing, secret_scan, simhash

QUERIES = {
    "op1_topk": bitslice.op1_topk,
    "op2_huffman": huffman.op2_huffman,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_langid": langid.op4_langid,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_lm_score": ngram_lm.op6_lm_score,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_packing": packing.op8_packing,
    "op9_url_filter": hosts.op9_url_filter,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {
    "op1_topk": bitslice.ORACLE,
    "op3_secrets": secret_scan.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_lm_score": ngram_lm.ORACLE,
    "op9_url_filter": hosts.ORACLE,
}

"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from tallyweir.llm import bpe, classifiers, countmin, divergence, fmindex, htmltext, linechunks, mixing, prefixtrie, setjoin, squares, warc

QUERIES = {
    "op1_fm_toxicity": classifiers.op1_fm_toxicity,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_line_chunks": linechunks.op3_line_chunks,
    "op4_divergence_rules": divergence.op4_divergence_rules,
    "op5_countmin_substrings": countmin.op5_countmin_substrings,
    "op6_warc_index": warc.op6_warc_index,
    "op7_fm_decontamination": fmindex.op7_fm_decontamination,
    "op8_nbsvm_quality": classifiers.op8_nbsvm_quality,
    "op9_jaccard_join": setjoin.op9_jaccard_join,
    "op10_html_text": htmltext.op10_html_text,
    "op11_bpe_transducer": bpe.op11_bpe_transducer,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_dyadic_runs": squares.op13_dyadic_runs,
}

ORACLES = {
    "op2_pareto_mix": mixing.ORACLE,
    "op3_line_chunks": linechunks.ORACLE,
    "op6_warc_index": warc.ORACLE,
    "op12_prefix_trie": prefixtrie.ORACLE,
}

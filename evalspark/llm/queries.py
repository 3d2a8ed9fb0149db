"""Registered queries of the training-data operators and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from evalspark.llm import bpe, centroids, filteraudit, htmltext, huffman, langid, mixing, passages, privacy, simhash, urlfilter, vectorgraph, vptree

QUERIES = {
    "op1_vantage_point_search": vptree.query,
    "op10_tag_path_text": htmltext.query,
    "op11_equal_average_clusters": centroids.query,
    "op12_posting_list_audit": filteraudit.query,
    "op13_information_sanitiser": privacy.query,
    "op2_url_char_models": urlfilter.query,
    "op3_simhash_anchor_cover": simhash.query,
    "op4_huffman_token_files": huffman.query,
    "op5_bpe_segment_tree": bpe.query,
    "op6_pivotal_mixing": mixing.query,
    "op7_naive_bayes_language": langid.query,
    "op8_compact_windows": passages.query,
    "op9_pruned_graph_near_dups": vectorgraph.query,
}

ORACLE: dict[str, str] = {
    "op11_equal_average_clusters": centroids.oracle_sql(),
    "op12_posting_list_audit": filteraudit.oracle_sql(),
    "op2_url_char_models": urlfilter.oracle_sql(),
    "op9_pruned_graph_near_dups": vectorgraph.oracle_sql(),
}

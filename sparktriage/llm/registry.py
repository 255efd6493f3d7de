"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from . import op1_brown, op2_lines, op3_bpe, op4_rans, op5_join, op6_rules, op7_mix, op8_secrets, op9_lang, op10_knn, op11_resample, op12_pieces, op13_vptree

QUERIES = {
    "op1_brown_lm": op1_brown.query,
    "op2_line_dedup": op2_lines.query,
    "op3_bpe_codec": op3_bpe.query,
    "op4_rans_ids": op4_rans.query,
    "op5_ngram_jaccard_join": op5_join.query,
    "op6_quality_rules": op6_rules.query,
    "op7_source_mix": op7_mix.query,
    "op8_secret_scan": op8_secrets.query,
    "op9_language_id": op9_lang.query,
    "op10_voronoi_knn": op10_knn.query,
    "op11_importance_resample": op11_resample.query,
    "op12_piece_codec": op12_pieces.query,
    "op13_vp_clustering": op13_vptree.query,
}

SQL = {
    "op2_line_dedup": op2_lines.SQL,
    "op10_voronoi_knn": op10_knn.SQL,
    "op11_importance_resample": op11_resample.SQL,
    "op13_vp_clustering": op13_vptree.SQL,
}

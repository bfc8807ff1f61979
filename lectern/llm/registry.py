"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from lectern.llm import decontaminate, language_id, licenses, ngram_join, piece_sampling, quality_model, quality_rules, suffix_tree, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        suffix_tree.op2_suffix_tree,
        url_filter.op3_url_filter,
        quality_rules.op4_quality_rules,
        licenses.op5_license_scan,
        decontaminate.op6_decontamination,
        warc.op7_revisits,
        ngram_join.op8_ngram_jaccard,
        quality_model.op9_quality_model,
        piece_sampling.op10_piece_sampling,
    )
}
ORACLES = {"op4_quality_rules": quality_rules.SQL, "op6_decontamination": decontaminate.SQL, "op8_ngram_jaccard": ngram_join.SQL}

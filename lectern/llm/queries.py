"""The queries of this package, by name."""

from __future__ import annotations

from lectern.llm import caps, decontamination, fim, licenses, lines, manifest, packing, pu_quality, rules, simhash, substrings, toxicity, urls

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        urls.op2_url_filters,
        lines.op3_line_dedup,
        rules.op4_quality_rules,
        pu_quality.op5_quality_classifier,
        simhash.op6_simhash_near_dedup,
        packing.op7_harmonic_packing,
        substrings.op8_substring_dedup,
        decontamination.op9_benchmark_decontamination,
        licenses.op10_license_scan,
        manifest.op11_merkle_manifest,
        caps.op12_embedding_near_dedup,
        fim.op13_fill_in_middle,
    )
}
ORACLES: dict[str, str] = {
    "op2_url_filters": urls.OP2_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op4_quality_rules": rules.OP4_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_embedding_near_dedup": caps.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
    "op9_benchmark_decontamination": decontamination.OP9_SQL,
}

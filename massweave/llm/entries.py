"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from massweave.llm import best_fit_packing, html_density, importance_resampling, kneser_ney, line_quality, media_wav, pii_bootstrap, piece_sampling, pipeline, string_kernel, t_occurrence, token_counts, variant_grouping, warc_derivatives

QUERIES = {
    "pipeline": pipeline.run,
    "op6_t_occurrence": t_occurrence.op6_t_occurrence,
    "op5_warc_derivatives": warc_derivatives.op5_warc_derivatives,
    "op9_piece_sampling": piece_sampling.op9_piece_sampling,
    "op3_pii_bootstrap": pii_bootstrap.op3_pii_bootstrap,
    "op10_kneser_ney": kneser_ney.op10_kneser_ney,
    "op1_best_fit_packing": best_fit_packing.op1_best_fit_packing,
    "op2_line_quality": line_quality.op2_line_quality,
    "op4_string_kernel": string_kernel.op4_string_kernel,
    "op7_html_density": html_density.op7_html_density,
    "op8_wav_peaks": media_wav.op8_wav_peaks,
    "op11_variant_grouping": variant_grouping.op11_variant_grouping,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op6_t_occurrence": t_occurrence.ORACLE_SQL, "op11_variant_grouping": variant_grouping.ORACLE_SQL, "op13_importance_resampling": importance_resampling.ORACLE_SQL}

"""The corpus queries, their SQL where it can express them, by name."""

from scorelake.llm import ann, chat, decontaminate, divergence, html_text, hyperminhash, line_dedup, mixing, ngram_join, quality, runs, secrets, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_html_text": html_text.op4_html_text,
    "op5_nearest": ann.op5_nearest,
    "op6_chat_format": chat.op6_chat_format,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_minhash_dedup": hyperminhash.op13_minhash_dedup,
    "secret_base": secrets.secret_base,
    "mix_targets": mixing.mix_targets,
}
SQL = {
    "mix_targets": mixing.MIX_TARGETS_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "secret_base": secrets.SECRET_BASE_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_minhash_dedup": hyperminhash.OP13_SQL,
}

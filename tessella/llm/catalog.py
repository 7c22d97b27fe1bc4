"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tessella.llm import collocations, conversations, decontaminate, html_text, lines, near_duplicates, nearest, quality, sentencepiece_codec, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op10_quality": quality.op10_quality,
    "op3_nearest": nearest.op3_nearest,
    "op4_warc": warc.op4_warc,
    "op5_html_text": html_text.op5_html_text,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op8_sharding": sharding.op8_sharding,
    "op11_simhash": simhash.op11_simhash,
    "op12_collocations": collocations.op12_collocations,
    "op13_conversations": conversations.op13_conversations,
}

SQL = {"op1_line_dedup": lines.OP1_SQL, "op4_warc": warc.OP4_SQL, "op12_collocations": collocations.OP12_SQL}

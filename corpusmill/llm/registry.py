"""The queries of this subpackage, one for each operator, over its whole table; SQL where SQL can express it."""

from corpusmill.llm import ann, collocations, gru_lm, id_files, langid, line_rules, packing, quality, simhash, token_count, toxicity, turn_repair, winnow

QUERIES = {
    "op1_decontaminate": winnow.query,
    "op2_quality": quality.query,
    "op3_simhash": simhash.query,
    "op4_pack": packing.query,
    "op5_neighbours": ann.query,
    "op6_lm_score": gru_lm.query,
    "op7_token_count": token_count.query,
    "op8_langid": langid.query,
    "op9_toxicity": toxicity.query,
    "op10_id_files": id_files.query,
    "op11_turn_repair": turn_repair.query,
    "op12_collocations": collocations.query,
    "op13_line_rules": line_rules.query,
}
SQL = {"op1_decontaminate": winnow.SQL, "op12_collocations": collocations.SQL, "op13_line_rules": line_rules.SQL}

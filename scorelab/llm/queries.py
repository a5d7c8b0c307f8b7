"""The registered queries of this subpackage and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from scorelab.llm.decontaminate import OP3_SQL, op3_decontamination
from scorelab.llm.divergence import OP12_SQL, op12_divergence
from scorelab.llm.language_id import op8_language_id
from scorelab.llm.mixture import OP13_SQL, op13_mixture
from scorelab.llm.neighbours import OP4_SQL, op4_neighbours
from scorelab.llm.packing import op9_packing
from scorelab.llm.repeats import op6_repeated_passages
from scorelab.llm.secret_scan import op5_secret_scan
from scorelab.llm.simhash import op10_simhash
from scorelab.llm.token_count import op1_token_counts
from scorelab.llm.token_files import op7_token_files
from scorelab.llm.toxicity import op2_toxicity
from scorelab.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_neighbours": op4_neighbours,
    "op5_secret_scan": op5_secret_scan,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_divergence": op12_divergence,
    "op13_mixture": op13_mixture,
}

ORACLE: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op4_neighbours": OP4_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_mixture": OP13_SQL,
}

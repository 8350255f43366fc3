"""The contract queries of this subpackage and their SQL."""

from parley.llm.alignment import op13_alignment
from parley.llm.archives import OP9_SQL, op9_warc
from parley.llm.decontamination import OP4_SQL, op4_benchmark_decontamination
from parley.llm.extraction import op10_html_extraction
from parley.llm.minmax import op11_minmax
from parley.llm.mixing import OP3_SQL, op3_mixing_sources
from parley.llm.quality_classifier import op8_quality_classifier
from parley.llm.quality_rules import op1_quality_rules
from parley.llm.repeats import op5_suffix_array_dedup
from parley.llm.sharding import op2_sharding
from parley.llm.simhash import op7_simhash
from parley.llm.spelling import op12_spelling_variants
from parley.llm.tokens import op6_token_ids

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_sharding, op3_mixing_sources, op4_benchmark_decontamination, op5_suffix_array_dedup,
        op6_token_ids, op7_simhash, op8_quality_classifier, op9_warc, op10_html_extraction,
        op11_minmax, op12_spelling_variants, op13_alignment,
    )
}

ORACLES = {"op3_mixing_sources": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op9_warc": OP9_SQL}

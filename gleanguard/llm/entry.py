"""The subpackage's queries and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from gleanguard.llm.bpe_codec import op8_bpe_codec
from gleanguard.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from gleanguard.llm.fingerprints import op2_fingerprints
from gleanguard.llm.ngram_join import op5_ngram_join
from gleanguard.llm.packing import op1_packing
from gleanguard.llm.records import op6_records
from gleanguard.llm.sharding import op9_sharding
from gleanguard.llm.suffix_dedup import op10_suffix_dedup
from gleanguard.llm.token_counts import op4_token_counts
from gleanguard.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_fingerprints, op3_toxicity, op4_token_counts, op5_ngram_join, op6_records, op7_exact_dedup, op8_bpe_codec, op9_sharding, op10_suffix_dedup)
}
ORACLE_SQL = {"op7_exact_dedup": OP7_SQL}

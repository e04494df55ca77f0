"""The queries of this subpackage and their SQL."""

from .op1_secret_scan import op1_secret_scan
from .op2_line_dedup import OP2_SQL, op2_line_dedup
from .op3_bpe_codec import op3_bpe_codec
from .op4_token_records import op4_token_records
from .op5_stupid_backoff import OP5_SQL, op5_stupid_backoff
from .op6_best_fit_packing import op6_best_fit_packing
from .op7_minmax_dedup import OP7_SQL, op7_minmax_dedup
from .op8_quality_outliers import op8_quality_outliers
from .op9_chroma_fingerprint import op9_chroma_fingerprint
from .op10_language_id import op10_language_id
from .op11_hard_negatives import OP11_SQL, op11_hard_negatives
from .op12_phrases import OP12_SQL, op12_phrases
from .op13_bloom_dedup import OP13_SQL, op13_bloom_dedup

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_bpe_codec, op4_token_records, op5_stupid_backoff, op6_best_fit_packing, op7_minmax_dedup, op8_quality_outliers, op9_chroma_fingerprint, op10_language_id, op11_hard_negatives, op12_phrases, op13_bloom_dedup)}
SQL = {"op2_line_dedup": OP2_SQL, "op5_stupid_backoff": OP5_SQL, "op7_minmax_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_phrases": OP12_SQL, "op13_bloom_dedup": OP13_SQL}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

"""The queries of the training-data operators, and SQL for those that SQL can express."""

from .alignment import op11_alignment
from .ann import op1_ann
from .divergence import OP13_SQL, op13_divergence
from .fingerprint import op10_fingerprints
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .packing import op6_packing
from .secret_scan import OP12_SQL, op12_secret_scan
from .sharding import op7_sharding
from .simhash import op8_simhash
from .substring_dedup import op3_substring_dedup
from .toxicity import op2_toxicity
from .url_filter import OP9_SQL, op9_url_filters

QUERIES = {
    "op1_ann": op1_ann,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_url_filters": op9_url_filters,
    "op10_fingerprints": op10_fingerprints,
    "op5_line_dedup_by_line": op5_line_dedup,  # an earlier name of the same
    "op11_alignment": op11_alignment,
    "op12_secret_scan": op12_secret_scan,
    "op13_divergence": op13_divergence,
}
ORACLES = {"op4_mixing": OP4_SQL, "op5_line_dedup": OP5_SQL, "op5_line_dedup_by_line": OP5_SQL, "op9_url_filters": OP9_SQL, "op12_secret_scan": OP12_SQL, "op13_divergence": OP13_SQL}

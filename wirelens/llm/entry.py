"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from .decontaminate import op10_decontaminate
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .html_extract import op2_html_extract
from .language_id import op3_language_id
from .line_dedup import op6_line_dedup
from .mixing import OP8_SQL, op8_mixing
from .packing import op13_packing
from .secrets import op5_secrets
from .sharding import op7_sharding
from .simhash import op4_simhash
from .spelling import op11_spelling_variants
from .tokens import op9_token_ids
from .whitening import op12_embedding_whitening

_ALL = (
    op1_exact_dedup, op2_html_extract, op3_language_id, op4_simhash, op5_secrets, op6_line_dedup, op7_sharding, op8_mixing, op9_token_ids, op10_decontaminate,
    op11_spelling_variants, op12_embedding_whitening, op13_packing,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op8_mixing": OP8_SQL}

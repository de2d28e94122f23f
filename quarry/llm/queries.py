"""The opN_ queries of this package and, where SQL can express them, their DuckDB SQL."""

from .fingerprints import op7_fingerprints
from .html_text import op2_html_extraction
from .language_model import op4_lm_scoring
from .mixing import op5_mixing
from .near_dups import op10_near_duplicates
from .neighbours import op1_nearest_neighbours
from .packing import op8_packing
from .quality import op3_quality
from .secrets import op9_secrets
from .token_files import op6_token_files

QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_html_extraction, op3_quality, op4_lm_scoring, op5_mixing, op6_token_files, op7_fingerprints, op8_packing, op9_secrets, op10_near_duplicates)}
ORACLE: dict[str, str] = {}

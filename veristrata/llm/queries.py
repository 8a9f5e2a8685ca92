"""The corpus queries that ``__spark_entry__`` registers, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op8_ann
from .decontaminate import OP5_SQL, op5_decontamination
from .langid import language_id_pages, op4_language_id
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op7_packing
from .pii import op9_pii
from .quality import op10_quality
from .repeats import op6_repeats
from .sharding import op13_sharding
from .simhash import op3_simhash
from .spelling import OP11_SQL, op11_spelling
from .urls import op2_url_filter
from .wordpiece import op1_token_counts

QUERIES = {"op1_token_counts": op1_token_counts, "op2_url_filter": op2_url_filter, "op3_simhash": op3_simhash, "op4_language_id": op4_language_id, "language_id_pages": language_id_pages, "op5_decontamination": op5_decontamination, "op6_repeats": op6_repeats, "op7_packing": op7_packing, "op8_ann": op8_ann, "op9_pii": op9_pii, "op10_quality": op10_quality, "op11_spelling": op11_spelling, "op12_hard_negatives": op12_hard_negatives, "op13_sharding": op13_sharding}
SQL: dict[str, str] = {"op5_decontamination": OP5_SQL, "op11_spelling": OP11_SQL, "op12_hard_negatives": OP12_SQL}

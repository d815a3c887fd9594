"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from spectrel.llm.ann import op6_nearest
from spectrel.llm.audit import OP11_SQL, op11_filter_audit
from spectrel.llm.decontam import OP3_SQL, op3_decontaminate
from spectrel.llm.licenses import op5_licenses
from spectrel.llm.linededup import OP13_SQL, op13_line_dedup
from spectrel.llm.lm import OP4_SQL, op4_backoff
from spectrel.llm.piecebpe import op7_sentencepiece
from spectrel.llm.quality import op10_quality
from spectrel.llm.sharding import op8_sharding
from spectrel.llm.simhash import op1_simhash
from spectrel.llm.tokencount import op9_token_counts
from spectrel.llm.urlfilter import op2_sql, op2_url_filter
from spectrel.llm.whitening import op12_whitening

QUERIES = {"op1_simhash": op1_simhash, "op2_url_filter": op2_url_filter, "op3_decontaminate": op3_decontaminate, "op4_backoff": op4_backoff, "op5_licenses": op5_licenses, "op6_nearest": op6_nearest, "op7_sentencepiece": op7_sentencepiece, "op8_sharding": op8_sharding, "op9_token_counts": op9_token_counts, "op10_quality": op10_quality, "op11_filter_audit": op11_filter_audit, "op12_whitening": op12_whitening, "op13_line_dedup": op13_line_dedup}
ORACLE: dict[str, str] = {"op2_url_filter": op2_sql(), "op3_decontaminate": OP3_SQL, "op4_backoff": OP4_SQL, "op11_filter_audit": OP11_SQL, "op13_line_dedup": OP13_SQL}

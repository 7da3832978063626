"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import corpus_pipeline
from cdrspark.llm.ann import op5_hnsw_sharded
from cdrspark.llm.bpe import op9_bpe_numpy_rounds
from cdrspark.llm.langid import op10_langid_bigru
from cdrspark.llm.linededup import OP8_SQL, op8_line_site_spread
from cdrspark.llm.media import op3_media_netpbm_bmp
from cdrspark.llm.mix import op1_mix_hypergeometric
from cdrspark.llm.orderminhash import op7_order_minhash
from cdrspark.llm.pii import op2_pii_skip_chain
from cdrspark.llm.quality import op4_quality_qda
from cdrspark.llm.warc import OP6_SQL, op6_warc_content_addressed

QUERIES = {f.__name__: f for f in (op1_mix_hypergeometric, op2_pii_skip_chain, op3_media_netpbm_bmp, op4_quality_qda, op5_hnsw_sharded, op6_warc_content_addressed, op7_order_minhash, op8_line_site_spread, op9_bpe_numpy_rounds, op10_langid_bigru)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op6_warc_content_addressed": OP6_SQL, "op8_line_site_spread": OP8_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

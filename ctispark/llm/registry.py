"""The queries of this subpackage and the SQL they must agree with."""

from ctispark.llm.audit import OP11_SQL, op11_audit
from ctispark.llm.bpe import op6_bpe
from ctispark.llm.embeddings import op4_embeddings
from ctispark.llm.html_text import op10_html
from ctispark.llm.jaccard import op7_jaccard
from ctispark.llm.langid import op2_langid
from ctispark.llm.manifest import OP12_SQL, op12_manifest
from ctispark.llm.mixing import OP3_SQL, op3_mixing
from ctispark.llm.quality import OP5_SQL, op5_quality
from ctispark.llm.scoring import op8_scoring
from ctispark.llm.secrets import OP9_SQL, op9_secrets
from ctispark.llm.sharding import OP13_SQL, op13_sharding
from ctispark.llm.substrings import op1_substrings

import corpus_pipeline

QUERIES = {"op1_substrings": op1_substrings, "op2_langid": op2_langid, "op3_mixing": op3_mixing, "op4_embeddings": op4_embeddings, "op5_quality": op5_quality, "op6_bpe": op6_bpe, "op7_jaccard": op7_jaccard, "op8_scoring": op8_scoring, "op9_secrets": op9_secrets, "op10_html": op10_html, "op11_audit": op11_audit, "op12_manifest": op12_manifest, "op13_sharding": op13_sharding, "pipeline": corpus_pipeline.run}
ORACLE = {"op3_mixing": OP3_SQL, "op5_quality": OP5_SQL, "op9_secrets": OP9_SQL, "op11_audit": OP11_SQL, "op12_manifest": OP12_SQL, "op13_sharding": OP13_SQL}

"""All registered queries: importing this module fills the registry."""

from qcorpus.plans import catalog_queries, corpus_queries, eval_queries, io_queries, model_queries, prompt_queries, text_queries  # noqa: F401
from qcorpus.plans.registry import IDS, ORACLE, QUERIES  # noqa: F401

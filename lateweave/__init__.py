"""Late-interaction retrieval data on Spark: triples, MaxSim scoring, metrics, gate fitting."""

from lateweave.functions.gate import Gate, gate_stats, init_gate, with_gate_weights
from lateweave.operators.gatefit import fit_gate, gate_features, gate_gradient, triple_features
from lateweave.operators.merge import merge_sources, seeded_shuffle, train_test_split
from lateweave.operators.metrics import retrieval_metrics
from lateweave.operators.ranking import exclude_ids, topk_per_query
from lateweave.operators.scoring import score_topk
from lateweave.operators.tokens import embed_tokens, embedding_drift, pack_tokens
from lateweave.operators.triples import explode_product, flatten_record, resolve_record
from lateweave.plans.evaluate import evaluate, evaluate_run, rank_queries

__version__ = "0.1.0"

__all__ = [
    "Gate", "embed_tokens", "embedding_drift", "evaluate", "evaluate_run", "exclude_ids",
    "explode_product", "fit_gate", "flatten_record", "gate_features", "gate_gradient",
    "gate_stats", "init_gate", "merge_sources", "pack_tokens", "rank_queries",
    "resolve_record", "retrieval_metrics", "score_topk", "seeded_shuffle", "topk_per_query",
    "train_test_split", "triple_features", "with_gate_weights",
]

"""Jobs built from the operators: the dimension run, the layers, the whole chain."""

from tidemark.plans.dimension import DimensionStore
from tidemark.plans.layers import build_gold, export_gold, ingest_files, run_chain
from tidemark.plans.mart import maintain_gold
from tidemark.plans.quarantine import replay_rejects

__all__ = ["DimensionStore", "build_gold", "export_gold", "ingest_files", "maintain_gold", "replay_rejects", "run_chain"]

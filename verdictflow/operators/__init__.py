from .compose import any_block, any_flag, majority, max_verdict, mean_score, unanimous
from .evaluators import AllowDeny, ColumnEvaluator, Historical, PythonEvaluator, Scorer, Threshold
from .ratelimit import admit, concurrency_at
from .routing import cells, owners, redirect_hint, shared_owner_pairs, topology_json

__all__ = ["AllowDeny", "ColumnEvaluator", "Historical", "PythonEvaluator", "Scorer", "Threshold", "admit", "any_block", "any_flag", "cells", "concurrency_at", "majority", "max_verdict", "mean_score", "owners", "redirect_hint", "shared_owner_pairs", "topology_json", "unanimous"]

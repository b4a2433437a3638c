from .config import FailureMode, PipelineConfig, RateLimit, Sharding
from .pipeline import Pipeline
from .registry import DecisionTypes

__all__ = ["DecisionTypes", "FailureMode", "Pipeline", "PipelineConfig", "RateLimit", "Sharding"]

"""Errors: one class a subject, each with a code and a detail."""

from __future__ import annotations


class VerdictflowError(Exception):
    codes: tuple[str, ...] = ()

    def __init__(self, code: str, detail: str = ""):
        if self.codes and code not in self.codes:
            raise ValueError(f"{type(self).__name__} has no code {code}")
        self.code, self.detail = code, detail
        super().__init__(f"{code}: {detail}" if detail else code)


class ConfigError(VerdictflowError):
    codes = ("RequiredStageMissing", "LatencyBudgetExceeded", "InvalidShardingConfig", "UndefinedStageDependency", "InvalidPolicyRule", "InvalidDecisionType", "InvalidConfig")


class EvaluatorError(VerdictflowError):
    codes = ("Timeout", "InternalError", "EvaluatorLoadFailed")


class StoreError(VerdictflowError):
    codes = ("Unavailable", "VersionConflict", "Corrupt")


class EmissionError(VerdictflowError):
    codes = ("TargetUnavailable", "RetryExhausted")


class RateLimitError(VerdictflowError):
    codes = ("Exhausted", "ConcurrencyCapReached")


class PipelineError(VerdictflowError):
    codes = ("AlreadyRunning", "NotStarted", "PipelineUnavailable", "DrainTimeout")


class SyncSubmitError(VerdictflowError):
    codes = ("NotStarted", "PipelineUnavailable", "RateLimited", "ValidationFailed", "Timeout", "Cancelled")

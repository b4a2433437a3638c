"""Emission to all targets, each with its own retries."""

from __future__ import annotations

import logging
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..plans.config import Emit

log = logging.getLogger("verdictflow.emit")


def emit(decisions: DataFrame, c: Emit, sleep=time.sleep) -> int:
    """Hand decisions to every target; one that fails is tried again after base, 2 base, 4 base ...
    milliseconds, retry_limit times, then given up. Returns how many decisions were dropped, over all
    targets; one target's failure touches neither the others nor any verdict."""
    kept = len(c.targets) > 1
    if kept:  # decided once, not once a target
        decisions = decisions.persist(StorageLevel.DISK_ONLY_2 if not decisions.isStreaming else StorageLevel.MEMORY_AND_DISK)
    dropped = 0
    try:
        for target in c.targets:
            for attempt in range(c.retry_limit + 1):
                try:
                    target(decisions)
                    break
                except Exception as e:  # a target's fault stays its own
                    log.warning("target %s failed (attempt %d): %s", type(target).__name__, attempt + 1, e)
                    if attempt == c.retry_limit:
                        dropped += decisions.count()
                    else:
                        sleep(c.base_ms * 2**attempt / 1000)
    finally:
        if kept:
            decisions.unpersist()
    return dropped

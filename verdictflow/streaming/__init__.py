from .reports import session_counts, sliding_counts, tumbling_counts
from .stateful import running_counts, token_buckets

__all__ = ["running_counts", "session_counts", "sliding_counts", "token_buckets", "tumbling_counts"]

from .fanout import emit
from .formats import audit_lines, decision_json, decisions_from_json, stdout_lines
from .targets import JsonFiles, Noop, ParquetFiles, Stdout, Table

__all__ = ["JsonFiles", "Noop", "ParquetFiles", "Stdout", "Table", "audit_lines", "decision_json", "decisions_from_json", "emit", "stdout_lines"]

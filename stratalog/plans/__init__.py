"""Programs as DataFrame plans."""

from .engine import RunResult, evaluate, run_dirs, run_string

__all__ = ["RunResult", "evaluate", "run_dirs", "run_string"]

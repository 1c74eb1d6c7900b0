"""Plans built by the driver: loops."""

from .loops import EmitKind, IterCondition, run_loop

__all__ = ["EmitKind", "IterCondition", "run_loop"]

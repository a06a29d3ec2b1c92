"""Written intermediate tables, as the whole library makes them."""

from ..operators.stored import Scratch, shared_dir, unused

__all__ = ["Scratch", "shared_dir", "unused"]

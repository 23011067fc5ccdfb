"""Places for intermediate tables, as everywhere in the library: the folder that the whole cluster shares."""

from __future__ import annotations

from ..sources.shared import folder as shared_dir
from ..sources.shared import fresh_path, remove, scratch, written

discard = remove

__all__ = ["discard", "fresh_path", "scratch", "shared_dir", "written"]

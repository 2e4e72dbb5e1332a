"""Typed reading of the input files, delimited export, checked lookups."""

from .crosswalks import crosswalk, read_crosswalk
from .layout import save_by_entity
from .readers import (
    audit_delimited,
    from_lines,
    prepare_enrollments,
    prepare_spells,
    read_enrollments,
    read_spells,
)
from .schemas import ENROLLMENTS, ENROLLMENTS_V2, SPELLS
from .writers import export_delimited, read_export, to_lines, write_delimited, write_lines

__all__ = [
    "ENROLLMENTS", "ENROLLMENTS_V2", "SPELLS", "audit_delimited", "crosswalk", "export_delimited",
    "from_lines", "prepare_enrollments", "prepare_spells", "read_crosswalk", "read_enrollments",
    "read_export", "read_spells", "save_by_entity", "to_lines", "write_delimited", "write_lines",
]

from .documents import document_id, iso_text, jsonify, utc_wall_clock
from .text import normalized_title, strip, text_or_empty

__all__ = [
    "document_id",
    "iso_text",
    "jsonify",
    "normalized_title",
    "strip",
    "text_or_empty",
    "utc_wall_clock",
]

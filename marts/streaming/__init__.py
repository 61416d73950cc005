from .upsert import file_stream, start_upsert

__all__ = ["file_stream", "start_upsert"]

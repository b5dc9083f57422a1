from .readers import meta_from_config, read_ntriples, read_table
from .rowid import with_row_id
from .writers import write_ntriples, write_stats, write_turtle

__all__ = [
    "meta_from_config",
    "read_ntriples",
    "read_table",
    "with_row_id",
    "write_ntriples",
    "write_stats",
    "write_turtle",
]

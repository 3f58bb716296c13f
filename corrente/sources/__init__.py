"""Where flows begin."""

from .generate import Endless, generate_infinite, generate_infinite_py, init_infinite
from .memory import empty, of_rows, of_seq, of_seqs, singleton
from .tables import of_table, read_csv, read_json, read_orc, read_parquet
from .text import of_stream_by_line, of_text_file_by_line, read_all_text

__all__ = ["Endless", "empty", "generate_infinite", "generate_infinite_py", "init_infinite", "of_rows", "of_seq", "of_seqs", "of_stream_by_line", "of_table", "of_text_file_by_line", "read_all_text", "read_csv", "read_json", "read_orc", "read_parquet", "singleton"]

"""Readers and writers."""

from .binary import VecDataSource, read_series, read_vec, write_vec
from .lists import read_list, read_parallel_list, read_seed_file

__all__ = ["VecDataSource", "read_list", "read_parallel_list", "read_seed_file", "read_series", "read_vec", "write_vec"]

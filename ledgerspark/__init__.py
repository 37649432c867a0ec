"""Spark-native analytics over company filings: reported facts, filing text and question answering.

Every public function takes DataFrames and returns a lazy DataFrame.
"""

from ledgerspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

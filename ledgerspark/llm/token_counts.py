"""Token counts of whole texts by a given public tokenizer.

Texts reach Python as Arrow batches and only lengths go back. A byte-level tokenizer never joins
bytes across a blank that a letter or digit follows, so texts are cut there, however long they are;
pieces are encoded in batches of about equal UTF-8 bytes, and the lengths of pieces seen before come
from a bounded memory. A stretch without such a blank is one piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import map_texts

ENCODE_BYTES = 1 << 18
REMEMBERED = 400_000
# A blank before a letter or digit always begins a new unit of the byte-level pattern.
SAFE_BREAK = re.compile(r" (?=[^\W_])")

_counters: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """Lengths of texts under one tokenizer file (``.json`` or ``.model``)."""

    def __init__(self, path: str, encode_bytes: int = ENCODE_BYTES, remembered: int = REMEMBERED):
        self.encode_bytes, self.remembered = encode_bytes, remembered
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            self.splits = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        before = layout.get("pre_tokenizer") or {}
        self.splits = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not layout.get("normalizer")
            and all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in layout.get("added_tokens", ()))
        )

    def _encode_balanced(self, texts: list[str]) -> list[int]:
        lengths: list[int] = []
        batch: list[str] = []
        held = 0
        for text in texts:
            batch.append(text)
            held += len(text.encode())
            if held >= self.encode_bytes:
                lengths += self.encode(batch)
                batch, held = [], 0
        return lengths + (self.encode(batch) if batch else [])

    def lengths(self, texts: Iterable[str]) -> list[int]:
        texts = list(texts)
        if not self.splits:
            return self._encode_balanced(texts)
        pieces = [SAFE_BREAK.split(text) for text in texts]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        new = list({p for first, *rest in pieces for p in rest if p not in known})
        known.update(zip(new, self._encode_balanced([" " + p for p in new])))
        firsts = self._encode_balanced([p[0] for p in pieces])
        # the blank belongs to the piece after it; the first piece of a text has none
        return [n + sum(map(known.__getitem__, p[1:])) for n, p in zip(firsts, pieces)]


def count_tokens(
    df: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text: (id, n_bytes, n_tokens, over_limit).

    ``tokenizer_path`` must exist on every executor. No begin, end or other added token is counted,
    nothing is truncated or padded, and special strings inside a text count as the library's default
    has it. A NULL or empty text has 0 bytes and 0 tokens; repeated rows are counted row by row; an
    empty table gives an empty result; columns other than the two named ones are ignored.
    """

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counters.get(tokenizer_path)
        if counter is None:
            counter = _counters[tokenizer_path] = TokenCounter(tokenizer_path)
        texts = [t or "" for t in batch["text"].to_pylist()]
        sizes = pc.binary_length(batch["text"]).fill_null(0).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch["id"], sizes, pa.array(counter.lengths(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"]
        )

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    counted = map_texts(source, "text", body, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

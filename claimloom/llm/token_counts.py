"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import local_file, slices_by_bytes, text_bytes
from claimloom.llm.encoding import SAFE_SPACE, encoder

#: UTF-8 bytes that one call of the library gets; longer texts are split into parts of about this size.
BATCH_BYTES = 1 << 22
PART_BYTES = 1 << 18

_loaded: dict[str, object] = {}


def _counter(path: str):
    """texts -> token counts for a .json (tokenizers) or .model (sentencepiece) file, loaded once in a worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if os.path.basename(path).startswith("byte_bpe"):
            _loaded[path] = encoder(path).count
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def split_safely(text: str, limit: int) -> list[str]:
    """Cuts a text before single spaces that start a new token in any case, into parts of about ``limit`` characters.

    A text without such a place stays whole. Only valid for byte-level BPE files; see ``encoding``.
    """
    parts, lo = [], 0
    while len(text) - lo > limit:
        cut = SAFE_SPACE.search(text, lo + limit)
        if cut is None:
            break
        parts.append(text[lo : cut.start()])
        lo = cut.start()
    return [*parts, text[lo:]]


def count_texts(path: str, texts: list[str], splits: bool = True) -> list[int]:
    """Token counts of texts, in batches balanced by bytes."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for part in split_safely(text, PART_BYTES) if splits else [text]:
            pieces.append(part)
            owner.append(i)
    count, out = _counter(path), [0] * len(texts)
    for lo, hi in slices_by_bytes([len(p) for p in pieces], BATCH_BYTES):
        for i, n in zip(owner[lo:hi], count(pieces[lo:hi]), strict=True):
            out[i] += n
    return out


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row's whole text; no shuffle.

    Null text counts as empty (0, 0, false); empty tables give empty results; repeated rows and null ids
    come out once for each row; other columns are not read. Only byte-level BPE texts are split when long:
    the other files are given whole texts.
    """
    def lengths(batches):
        import pyarrow as pa

        path = local_file(tokenizer)
        splits = tokenizer.startswith("byte_bpe")
        for batch in batches:
            texts = [b.decode() for b in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count_texts(path, texts, splits), pa.int64())], ["id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = chosen.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(lengths, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Packing by power-of-two decomposition: every piece of a document has a binary length, equal lengths share a bucket, and no sequence crosses documents.

A document of n tokens becomes n // max_len pieces of max_len and one piece for each set bit of the remainder, longest first.
Each piece is a sequence of its own, of a power-of-two length, so nothing is padded.

Defined results: a null or empty text has the end token alone; a null doc_id is kept as null; repeated rows are packed one by one;
an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import prefix_sums
from .common import Scratch, broadcast_if_small

_encoders: dict[str, object] = {}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the order of the merges is the order of their products' ids; None if it is not."""
    model, special = spec["model"], {t["content"] for t in spec.get("added_tokens") or ()}
    pre = spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not usual or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    of = _byte_of_char()
    return {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}


#: The split of the byte-level pre-tokenizer. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """A function from text to ids, equal to `tokenizers` with add_special_tokens=False on the file at path.

    tiktoken runs the same vocabulary several times faster; it is used only where the file is a plain byte-level BPE whose
    merges are in id order, which makes both give the same ids. Other files go through `tokenizers` itself.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ranks := _ranked(spec):
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
            coder = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            _encoders[path] = lambda text: coder.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            _encoders[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens: as many of max_len as fit, then the powers of two in the rest, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if asked for, ids.

    sequence_id counts from 0 through the buckets, longest first, so a batch of equal lengths is a range of ids. Tasks number their
    pieces within each bucket; the offsets between tasks come from a table of one row per task and bucket.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("task", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, task int, nth long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        out: list[list] = [[] for _ in fields]
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            made = pa.record_batch([pa.array(c, type=t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)
            for c in out:
                c.clear()
            held = 0
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                start = 0
                for length in binary_lengths(len(ids), max_len):
                    piece, bucket = ids[start : start + length], length.bit_length() - 1
                    nth = seen.get(bucket, 0)
                    seen[bucket] = nth + 1
                    row = [doc_id, start, length, zlib.crc32(piece.tobytes()), len(ids), bucket, task, nth] + [piece.astype(np.int32)] * with_ids
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    start += length
                held += len(ids) if with_ids else 64
                if held > 1_000_000:
                    yield flush()
        if out[0]:
            yield flush()

    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, ddl), "pieces")
    counts = pieces.groupBy("bucket", "task").agg(F.count("*").alias("n"))
    # A row for each task and bucket.
    offsets = scratch.save(prefix_sums(counts, [F.desc("bucket"), "task"], {"base": F.col("n")}).select("bucket", "task", "base"), "offsets")
    joined = pieces.join(broadcast_if_small(offsets, offsets.count(), 24), ["bucket", "task"])
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *(["ids"] if with_ids else []))

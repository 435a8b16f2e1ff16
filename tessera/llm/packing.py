"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents in a fixed pseudo-random order.  A round
gives every queue a quantum, its target share of one window of tokens; a queue
sends documents as long as its deficit (quanta received less tokens sent)
covers the next one, and keeps the rest of the deficit for later rounds.  So
the document that ends at token e of its queue leaves in round
ceil(e / quantum) - 1, whatever partition it lies in: deficits carry over
windows and partitions in closed form, and the schedule needs running sums
only.  Documents are laid end to end in schedule order (round, source,
position) and cut every `window` tokens, so only the last sequence is padded.
By default a source's share is its share of all tokens and all queues run dry
together; a queue that runs dry early leaves its windows to the others.

Ids are those of the tokenizer file.  The byte-level BPE engine used reads the
vocabulary of that file and gives the same ids as its own library, faster; an
added token of the file that stands in a text gets its own id, as there.

Cases: null text is empty text, whose one piece is the separator; rows that
repeat are packed as often as they occur; a null source is a queue of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.prefix import bucket_count, running_total
from tessera.llm.storage import small_batches, staged

WINDOW = 1024
SEPARATOR = 0
# Texts tokenized between two output batches.
_CHUNK_CHARS = 4_000_000
_PIECES_SCHEMA = (
    "row_id long, doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A BPE encoder from a byte-level tokenizer file whose ids are its merge ranks."""
    import tiktoken
    import public_tokenizers

    file = json.load(open(path, encoding="utf-8"))
    vocab = file["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=8)
def id_kind(path: str) -> str:
    """The narrowest unsigned type that holds every id of a tokenizer file."""
    file = json.load(open(path, encoding="utf-8"))
    top = max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(row_id, doc_id, source, n_tokens, crc, ids): ids as little-endian numbers of id_kind, the separator last."""
    kind = id_kind(tokenizer)
    width = int(kind[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                ids = [np.append(enc.encode_to_numpy(t, allowed_special="all"), SEPARATOR).astype(kind).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in ("row_id", "doc_id", "source")],
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row_id", "doc_id", "source", "n_tokens", "crc", "ids"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "row_id long, doc_id long, source string, n_tokens long, crc long, ids binary")


def schedule(rows: DataFrame, window: int = WINDOW, weights: dict[str | None, float] | None = None, seed: int = 11) -> DataFrame:
    """(row_id, begin): each row's first token in the packed stream.

    rows: (row_id, doc_id, source, n_tokens, crc), staged.  weights: target
    token shares by source, by default the sources' own shares.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    if not total.n:
        return rows.select("row_id", F.col("n_tokens").alias("begin"))
    buckets = bucket_count(total.n)
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    mixed = F.xxhash64("doc_id", "crc", F.lit(seed))
    rows = rows.select("row_id", "doc_id", "n_tokens", "crc", queue.alias("queue"), mixed.alias("mixed"), F.pmod(mixed, F.lit(buckets)).alias("bucket"))
    ended = running_total(rows, ["queue"], "bucket", [F.col(c) for c in ("mixed", "doc_id", "crc", "row_id")], "n_tokens", "end")
    share = rows.groupBy("queue").agg(F.sum("n_tokens").alias("held"))
    if weights is None:
        share = share.select("queue", (F.col("held") / F.lit(float(total.t))).alias("share"))
    else:
        whole = float(sum(weights.values()))
        named = {"" if k is None else f"s{k}": v / whole for k, v in weights.items()}
        look = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
        share = share.select("queue", F.element_at(look, F.col("queue")).alias("share"))
    ended = ended.join(share, "queue").withColumn("round", F.ceil(F.col("end") / (F.col("share") * window)).cast("long") - 1)
    per_chunk = max(1, round(total.t / window / buckets))
    ended = ended.withColumns({"all": F.lit(0), "chunk": F.floor(F.col("round") / per_chunk)})
    order = [F.col(c) for c in ("round", "queue", "end", "row_id")]
    placed = running_total(ended, ["all"], "chunk", order, "n_tokens", "stop")
    return placed.select("row_id", (F.col("stop") - F.col("n_tokens")).alias("begin"))


def _cut(window: int, with_ids: bool, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, sizes, data = batch.column("begin").to_numpy(), batch.column("n_tokens").to_numpy(), batch.column("ids")
            which, start, length, crc, ids = [], [], [], [], []
            for i, (g, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
                edges = [0, *range(window - g % window, n, window), n]
                raw = np.frombuffer(data[i].as_buffer(), kind).astype("<u4").tobytes()
                for a, b in zip(edges, edges[1:]):
                    part = raw[4 * a : 4 * b]
                    which.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            take, start = np.array(which, np.int64), np.array(start, np.int64)
            at = begins[take] + start if len(take) else start
            cols = [batch.column(c).take(pa.array(take)) for c in ("row_id", "doc_id", "source")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column("n_tokens").take(pa.array(take)),
                 pa.array(at // window), pa.array(at % window), pa.array(ids, pa.binary())],
                [f.split()[0] for f in _PIECES_SCHEMA.split(", ")],
            )
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, weights: dict[str | None, float] | None = None,
         with_ids: bool = True, seed: int = 11) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    docs: doc_id, source, text.  ids are little-endian uint32 (null without
    with_ids).
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    table = staged(tokens(docs, tokenizer), "tokens", "zstd")
    begin = schedule(table.drop("ids"), window, weights, seed)
    placed = table.select("row_id", "doc_id", "source", "n_tokens", "ids").join(begin, "row_id")
    return placed.mapInArrow(_cut(window, with_ids, id_kind(tokenizer)), _PIECES_SCHEMA)

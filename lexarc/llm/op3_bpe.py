"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts longer than a chunk are cut into overlapping chunks, which are pre-tokenised in parallel. Where two
neighbouring chunks have a pre-token boundary in common, their pre-tokens agree from there on, since the pattern
looks only ahead; the chunks are stitched at the first such boundary and each encodes the pieces up to the next one.
Decoding concatenates the raw bytes of the ids. A text whose neighbouring chunks never agree (a single pre-token
longer than the overlap) is put together again and encoded in one piece.

A null text counts as empty and has no ids. Every input row gives one output row, with or without an id; repeated rows stay
repeated. Long rows are numbered in the order of the frame, so the frame is a scan or a kept table, which gives lost tasks
the same rows again.
Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read

CHUNK, OVERLAP = 32_768, 1_024
CACHE = 60_000


class Codec:
    """Ranks and pattern of a public vocabulary; encodes one pre-token at a time and remembers frequent ones."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._merge(piece.encode("utf-8")))
        if len(piece) <= 32:
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text whose ends are pre-token boundaries of the whole text."""
        return self.encode_pieces(self.split.findall(text))

    def encode_pieces(self, pieces) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += self._known.get(p) or self.piece(p)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def exact_matches(split, text: str, last: bool) -> list[tuple[int, int]]:
    """Spans of the pre-tokens that the end of the chunk can't have changed: those that end before it."""
    spans = [m.span() for m in split.finditer(text)]
    if not last:
        while spans and spans[-1][1] >= len(text):
            spans.pop()
    return spans


def _lists(rows: list[list[int]]) -> pa.Array:
    import itertools

    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>, decoded binary): the ids of each whole text and the bytes that they decode to."""
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, decoded binary"
    slice_rows = 256

    def whole(batches):
        c = codec(ranks_path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                b = big.slice(at, slice_rows)
                ids = [c.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), pa.array([c.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    short = docs.filter(F.length("text") <= chunk).mapInArrow(whole, schema)

    def cut_up(batches):
        for b in batches:
            for at in range(b.num_rows):
                text, one = b.column(2)[at].as_py(), b.slice(at, 1)
                count = max(1, -(-(len(text) - overlap) // chunk))
                for begin in range(0, count, slice_rows):
                    ks = range(begin, min(count, begin + slice_rows))
                    again = pa.array(np.zeros(len(ks), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [one.column(0).take(again), one.column(1).take(again), pa.array(ks, pa.int32()), pa.array([k * chunk for k in ks], pa.int32()),
                         pa.array([k * chunk + chunk + overlap >= len(text) for k in ks]), pa.array([text[k * chunk:(k + 1) * chunk + overlap] for k in ks], pa.string())],
                        names=[id_col, "row_id", "chunk_no", "start", "is_last", "part"])

    long = docs.filter(F.length("text") > chunk).withColumn("row_id", F.monotonically_increasing_id()).select(id_col, "row_id", "text")
    pieces = long.mapInArrow(cut_up, f"`{id_col}` {kind}, row_id long, chunk_no int, start int, is_last boolean, part string").repartition("row_id", "chunk_no")
    pieces_schema = f"`{id_col}` {kind}, row_id long, chunk_no int, start int, is_last boolean, part string, head array<int>, tail array<int>"

    def pretokenise(batches):
        split = codec(ranks_path, pattern).split
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                b = big.slice(at, slice_rows)
                head, tail = [], []
                for start, last, part in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                    begins = [s for s, _ in exact_matches(split, part, last)]
                    head.append([start + s for s in begins if s < overlap])
                    tail.append([start + s for s in begins if s >= chunk] if not last else [])
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(head), _lists(tail)], names=[*b.schema.names, "head", "tail"])

    w = W.partitionBy("row_id").orderBy("chunk_no")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    seen = pieces.mapInArrow(pretokenise, pieces_schema).withColumn("hi", F.when(~F.col("is_last"), cut)).withColumn(
        "lo", F.coalesce(F.lag("hi").over(w), F.lit(0))).withColumn(
        "whole", F.max(F.expr("hi is null and not is_last")).over(W.partitionBy("row_id")))
    parts_schema = f"`{id_col}` {kind}, row_id long, chunk_no int, ids array<int>, kept string"

    def encode_parts(batches):
        c = codec(ranks_path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                b = big.slice(at, slice_rows)
                got = [[] if r["whole"] else c.encode_pieces(r["part"][s:e] for s, e in exact_matches(c.split, r["part"], r["is_last"])
                                                             if s + r["start"] >= r["lo"] and (r["is_last"] or s + r["start"] < r["hi"])) for r in b.to_pylist()]
                kept = [(r["part"] if r["is_last"] else r["part"][:chunk]) if r["whole"] else None for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(got), pa.array(kept, pa.string())],
                                                 names=[id_col, "row_id", "chunk_no", "ids", "kept"])

    stitched = seen.drop("head", "tail").mapInArrow(encode_parts, parts_schema).groupBy("row_id", id_col).agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "ids", "kept"))).alias("parts"))
    again = stitched.filter("parts[0].kept is not null").select(
        id_col, F.expr("concat_ws('', transform(parts, p -> p.kept))").alias("text")).mapInArrow(whole, schema)

    def decode(batches):
        c = codec(ranks_path, pattern)
        for big in batches:
            for at in range(0, big.num_rows, slice_rows):
                b = big.slice(at, slice_rows)
                decoded = [c.decode(np.asarray(x.values).tolist()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    joined = stitched.filter("parts[0].kept is null").select(id_col, F.expr("flatten(transform(parts, p -> p.ids))").alias("ids")).mapInArrow(decode, schema)
    return short.unionByName(joined).unionByName(again)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    got = encode_decode(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES, SQL = {"op3_bpe": op3_bpe}, {}

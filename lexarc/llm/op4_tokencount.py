"""Token counts by a linear longest-match automaton.

A trie of the vocabulary has a failure link at each node, and beside it the number of tokens that following the link
emits. Running a word through the automaton adds these counts, so it gives the number of greedy longest-match pieces in
one pass over the word's bytes, without building the pieces.

A word is a run of characters other than white space, matched with a leading blank, as byte-level vocabularies write the
beginning of a word; a word that the vocabulary can't cover counts as one unknown token. Null, empty and blank texts have no
tokens. Every row gives one row, with or without an id, repeated ones too. Texts are counted whole. Columns other than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

REMEMBERED = 200_000
SLICE = 512


class Automaton:
    """Longest match over byte strings. Node 0 is the root, and where matching goes on after a token."""

    def __init__(self, vocabulary):
        self.step: dict[int, int] = {}
        ends = bytearray(1)
        depth_order = [(0, 0, 0)]  # node, parent, byte
        step = self.step
        for token in vocabulary:
            node = 0
            for c in token:
                key = node << 8 | c
                child = step.get(key)
                if child is None:
                    child = step[key] = len(ends)
                    ends.append(0)
                    depth_order.append((child, node, c))
                node = child
            if node:
                ends[node] = 1
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        children: dict[int, list[tuple[int, int]]] = {}
        for node, parent, c in depth_order[1:]:
            children.setdefault(parent, []).append((node, c))
        level = [0]
        while level:
            below = []
            for u in level:
                for v, c in children.get(u, ()):
                    if ends[v]:
                        self.fail[v], self.pops[v] = 0, 1
                    else:
                        z, n = self.fail[u], self.pops[u]
                        while z >= 0 and (z << 8 | c) not in step:
                            n += self.pops[z]
                            z = self.fail[z]
                        if z >= 0:
                            self.fail[v], self.pops[v] = step[z << 8 | c], n
                    below.append(v)
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if the vocabulary doesn't cover it."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := step.get(u << 8 | c)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class Counter(dict):
    """Counts of words seen before, up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(ranks_path: str) -> Counter:
    with open(ranks_path, "rb") as f:
        return Counter(Automaton(base64.b64decode(line.split()[0]) for line in f if line.strip()))


def count_tokens(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        known = counter(ranks_path)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                words = [(t or "").split() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"))


QUERIES, SQL = {"op4_tokencount": op4_tokencount}, {}

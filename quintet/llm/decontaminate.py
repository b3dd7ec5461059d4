"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of bytes that are ASCII letters or digits or part of a
non-ASCII character, with A-Z lower-cased: the pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing. A document is
normalised to its words with single spaces and scanned once for windows: any
`window` consecutive words of an item, or all words of an item of fewer.

The automaton needn't hold every window, which would store each word of an item
`window` times. Of `window` = 13 consecutive words, seven that start at a
multiple of seven in their item are always among them; so the keys are these
pieces, side by side, and a piece that is found is extended word by word along
its item: where the run reaches `window` words, all of it is hit. Since
normalising changes no byte's place before the spaces are closed up, a matched
word maps back to its place in the original text.

The items are broadcast, so their size is checked, in bytes of normalised text,
which bounds the automaton's nodes: up to `most_nodes` there is one automaton,
which each Python worker builds once, and every text is scanned once. A larger
benchmark is dealt into as few automata as keep the bound; they are built and
scanned one after another, with a document's hits carried from each to the
next, so the result is the same. The documents are never shuffled; nothing
depends on how they are dealt.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words marks nothing; items with equal text are all counted; an
item whose id is null marks words but is not among the counted items; rows
repeated in either table are each judged or counted once by id. Further
columns of documents are kept as they are, save those named like a result,
which the result replaces.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.llm import common

WINDOW = 13
#: Nodes of an automaton in each Python worker, at some 60 bytes each.
NODES = 8 << 20
#: Texts that are scanned before the next automaton is built, where there are several.
PIECE = 64 << 20
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType()),
])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(common.LOWER_WORDS).split()


def spaced(words: list[bytes]) -> str:
    """Words with a space around each; latin-1 gives one character a byte, so the automaton works on bytes."""
    return b" ".join([b"", *words, b""]).decode("latin-1")


class Scanner:
    """The automaton over pieces of items (id, normalised text)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        import ahocorasick

        self.window, step = window, (window + 1) // 2
        self.items = [(ident, text.split()) for ident, text in items]
        pieces: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        for k, (_, words) in enumerate(self.items):
            size = min(len(words), window - step + 1 if len(words) >= window else window)
            for j in range(0, len(words) - size + 1, step) if size else ():
                pieces.setdefault(spaced(words[j : j + size]), (size, []))[1].append((k, j))
        self.automaton = ahocorasick.Automaton()
        for key, found in pieces.items():
            self.automaton.add_word(key, found)
        self.any = bool(pieces)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, str | None]]:
        """(first word, one past the last, item) of each run of words that windows of an item cover."""
        out: list[tuple[int, int, str | None]] = []
        if not self.any or not words:
            return out
        ends = None
        until: dict[tuple[int, int], int] = {}  # how far an item has been followed from a place
        for at, (size, places) in self.automaton.iter(spaced(words)):
            if ends is None:  # where each word's closing space is
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, at)) + 1
            for k, j in places:
                first, end = last - size, last
                if until.get((k, first - j), 0) >= end:
                    continue
                ident, own = self.items[k]
                i, n = first - j, len(own)  # where the item's first word would be
                while first > max(0, i) and words[first - 1] == own[first - 1 - i]:
                    first -= 1
                while end < min(len(words), i + n) and words[end] == own[end - i]:
                    end += 1
                until[k, i] = end
                if end - first >= min(self.window, n):
                    out.append((first, end, ident))
        return out


_built: dict[str, Scanner] = {}


def scanner(name: str, items: list, window: int) -> Scanner:
    """The automaton of a call's only or current block; a worker holds one at a time and keeps it from task to task."""
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(items, window)
    return _built[name]


def judged(text: bytes | None, n_words: int, found: list, percent: int):
    """A row of RESULT, from all of a text's hits."""
    if not found:
        return n_words, 0, 0, [], [], False
    mark = np.zeros(n_words + 1, np.int64)
    for a, b, _ in found:
        mark[a] += 1
        mark[b] -= 1
    hit = np.cumsum(mark[:-1]) > 0
    n_hit, items = int(hit.sum()), sorted({x[2] for x in found} - {None})
    return n_words, n_hit, len(items), items, spans(text, hit), n_hit * 100 >= percent * n_words


def spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets into the original text."""
    raw = np.frombuffer(text.translate(common.LOWER_WORDS), np.uint8)
    word = np.concatenate([[False], raw != 0x20, [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    char = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(char[starts[a]]), "end": int(char[ends[b - 1]])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, most_nodes: int) -> list[list[tuple[str | None, bytes]]]:
    """(id, normalised text) of items with words, in blocks of up to `most_nodes` bytes; a longer item is a block."""
    blocks: list[list] = [[]]
    size = 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if not (own := b" ".join(words_of((text or "").encode()))):
            continue
        if blocks[-1] and size + len(own) > most_nodes:
            blocks.append([])
            size = 0
        blocks[-1].append((item, own))
        size += len(own) + 1
    return blocks


def find(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, percent: int = 5, most_nodes: int = NODES,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, spans and contaminated.

    contaminated: some word is hit, and at least `percent` of 100 words are.
    spans: character ranges of the original text that hit words cover.
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast((uuid.uuid4().hex, b, window)) for b in blocks_of(benchmark, item_id, item_text, most_nodes)]
    docs = docs.drop(*[f.name for f in RESULT])
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RESULT)
        for b in common.by_bytes(batches, text_col, PIECE if len(sent) > 1 else 8 << 20):
            texts = common.utf8(b.column(text_col))
            sizes, found = [0] * len(texts), [[] for _ in texts]
            for part in sent:
                own = scanner(*part.value)
                for i, text in enumerate(texts):
                    words = words_of(text)
                    sizes[i] = len(words)
                    found[i] += own.scan(words)
            rows = [judged(*x, percent) for x in zip(texts, sizes, found, strict=True)]
            more = [pa.array(list(column), f.type) for f, column in zip(arrow, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], schema=pa.schema([*b.schema, *arrow]))

    return docs.mapInArrow(scan, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents` against `benchmark`."""
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones, in their own columns."""
    own, name, back = common.masked(docs)
    return back(find(own, common.table(spark, sf_dir, "benchmark"), text_col=name["text"]).filter(~F.col("contaminated")))

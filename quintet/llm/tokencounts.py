"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once with a lossless byte-level BPE, so the byte
lengths of its tokens give each token's span in the text. Sections are spans
too; both lists ascend, so the interval join of tokens to sections is a merge.
A token that crosses boundaries goes by an explicit rule:

    start     to the section that holds its first byte
    majority  to the section that holds most of its bytes, the earlier if even
    split     to every section that it touches, in proportion to its bytes

Sections of `documents` are its lines, each with the line break that ends it.

Defined results: a null or empty text has no tokens and one empty section;
every row is counted on its own; extra columns are kept, save those named like
a result, which the result replaces.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.llm import common

#: White space as the tokenizer's pattern has it, two or more; and how long a run is merged by itself.
SPACES, RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2,}"), 100_000
RULES = ("start", "majority", "split")
RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_sections", T.LongType()),
    T.StructField("n_crossing", T.LongType()),
    T.StructField("section_tokens", T.ArrayType(T.DoubleType())),
])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBpe:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("quintet", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ids(self, text: str) -> list[int]:
        """The whole text's tokens.

        The library's splitter overflows on runs of about a million white-space
        characters. In its pattern such a run, but for its last character if
        something follows, is one piece, and what stands before and behind is
        split as if alone; so long runs are merged as pieces of their own.
        """
        if len(text) < RUN:
            return self.encode.encode_ordinary(text)
        out, at = [], 0
        for m in SPACES.finditer(text):
            end = m.end() - (m.end() < len(text))
            if end - m.start() >= RUN:
                out += self.encode.encode_ordinary(text[at : m.start()]) + self.encode._encode_single_piece(text[m.start() : end])
                at = end
        return out + self.encode.encode_ordinary(text[at:])

    def spans(self, text: str) -> np.ndarray:
        """Ends of the tokens, in bytes."""
        return np.cumsum(self.lengths[np.asarray(self.ids(text), np.int64)])


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def line_ends(text: bytes) -> np.ndarray:
    """Ends of the lines in bytes; a line holds the break that ends it, the last has none."""
    return np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1, len(text))


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and how many cross a boundary, from ascending ends of both."""
    counts = np.zeros(len(sections))
    if not len(tokens):
        return counts, 0
    starts = np.concatenate([[0], tokens[:-1]])
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, tokens - 1, side="right")
    crossing = np.flatnonzero(first != last)
    home = first
    if rule == "start" or not len(crossing):
        np.add.at(counts, home, 1)
        return counts, len(crossing)
    inner = first == last
    np.add.at(counts, home[inner], 1)
    for i in crossing:
        edges = np.clip(sections[first[i] : last[i] + 1], starts[i], tokens[i])
        share = np.diff(np.concatenate([[starts[i]], edges]))
        if rule == "split":
            counts[first[i] : last[i] + 1] += share / share.sum()
        else:
            counts[first[i] + int(share.argmax())] += 1
    return counts, len(crossing)


def count(docs: DataFrame, *, tokenizer: str, text_col: str = "text", rule: str = "majority", section_ends=line_ends, sizes_col: str | None = None) -> DataFrame:
    """docs with n_tokens, n_sections, n_crossing and section_tokens.

    Sections end where section_ends(text) says, in bytes, or after the sizes in sizes_col.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    docs = docs.drop(*[f.name for f in RESULT])
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])

    def attribute(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, arrow = load(tokenizer), to_arrow_schema(RESULT)
        for b in common.by_bytes(batches, text_col):
            rows, sizes = [], b.column(sizes_col).to_pylist() if sizes_col else None
            for i, text in enumerate(common.utf8(b.column(text_col))):
                text = text or b""
                tokens, sections = bpe.spans(text.decode()) if text else np.zeros(0, np.int64), np.cumsum(sizes[i]) if sizes else section_ends(text)
                counts, crossing = allocate(tokens, sections, rule)
                rows.append((len(tokens), len(sections), crossing, counts))
            more = [pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], schema=pa.schema([*b.schema, *arrow]))

    return docs.mapInArrow(attribute, schema)


def count_fields(docs: DataFrame, fields: list[str], *, tokenizer: str, rule: str = "majority", between: str = "\n") -> DataFrame:
    """docs with the counts of count(), whose sections are the fields' texts, joined by `between`, which belongs to the field before.

    A null field is an empty one. A field may hold the separator: boundaries come from the fields' lengths.
    """
    joined = docs.withColumn("__text", F.concat_ws(between, *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
    sizes = F.array(*[F.octet_length(F.coalesce(F.col(c), F.lit(""))) + F.lit(len(between.encode()) if c != fields[-1] else 0) for c in fields])
    return count(joined.withColumn("__ends", sizes), tokenizer=tokenizer, text_col="__text", rule=rule, sizes_col="__ends").drop("__text", "__ends")


def characters(text: str, ends: np.ndarray) -> np.ndarray:
    """Byte offsets as character offsets; one inside a character is where that character starts."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)
    return np.cumsum(starts)[ends] - 1


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of `documents`, crossing ones to the line that holds most of their bytes."""
    found = count(common.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=vocabulary())
    return found.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.col("section_tokens").cast("array<long>").alias("section_tokens"))

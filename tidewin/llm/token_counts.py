r"""Token counts of sections, from one encoding of the whole document.

A document is encoded once; each token's byte span follows from the token's length, and is turned into a
character span. The spans are joined to the document's sections, which are intervals of characters that
tile the text: a merge of two sorted interval lists. A token that crosses a section's end goes to one
section by a stated rule: `majority` (default: the section with most of its bytes, of equals the
earlier), `start` or `end` (the section of its first or last byte). So section counts add up to the
document's count, which encoding sections one by one would not give.

Sections are lines with their line end, or fields whose ends, in characters, a column lists. Defined cases: a null
or empty text has one empty section and no tokens; a text that ends in a line feed has no empty last section; field
ends beyond the text or before an earlier one are moved to it, and what follows the last field is one more (so a null
list makes the text one field); repeated rows and null ids are counted each; an empty table gives an empty result;
other columns are not read. Tokens are attributed CHUNK at a time, so a long text takes little beside its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import read, slices, to_tasks, with_ids

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level vocabulary's public splitting pattern (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "start", "end")
BATCH_BYTES = 4 << 20
CHUNK = 1 << 18


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file, read where the job starts; tasks get its bytes, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a vocabulary and the byte length of each of its tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    return tokenizer(vocabulary_bytes(path))


def line_ends(text: bytes) -> np.ndarray:
    """Byte ends of the sections: after each line feed, and the end of the text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.r_[ends, len(text)]


def field_ends(text: bytes, ends: list[int | None] | None) -> np.ndarray:
    """Byte ends of fields whose character ends are given; the last one ends with the text."""
    begins = np.r_[np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text)]
    given = np.array([e for e in ends or [] if e is not None], np.int64)
    at = begins[np.maximum.accumulate(np.clip(given, 0, len(begins) - 1))] if len(given) else np.zeros(0, np.int64)
    return at if len(at) and at[-1] == len(text) else np.r_[at, len(text)]


def attribute(ends: np.ndarray, lengths: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For tokens of these byte lengths: how many each section [.., end) gets, and how many cross its end."""
    n = len(ends)
    got, crossing, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for k in range(0, len(lengths), CHUNK):
        part = lengths[k : k + CHUNK].astype(np.int64)
        stop = at + np.cumsum(part)
        start, at = stop - part, int(stop[-1])
        first = np.searchsorted(ends, start, side="right")
        last = np.searchsorted(ends, stop - 1, side="right")
        cross = last > first
        to = first.copy() if rule != "end" else last
        if rule == "majority" and cross.any():
            # Every crossing token's pieces end to end; of equal ones the first counts.
            t = np.flatnonzero(cross)
            cuts = last[t] - first[t]
            of = np.repeat(np.arange(len(t)), cuts + 1)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts + 1) - cuts - 1, cuts + 1)
            section = first[t][of] + nth
            size = np.where(nth == cuts[of], stop[t][of], ends[section]) - np.where(nth == 0, start[t][of], ends[section - 1])
            widest = np.flatnonzero(size == np.maximum.reduceat(size, np.flatnonzero(nth == 0))[of])
            to[t] = section[widest[np.unique(of[widest], return_index=True)[1]]]
        got += np.bincount(to, minlength=n)
        crossing += np.bincount(first[cross], minlength=n)
    return got, crossing


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "majority", ends_col: str | None = None) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens, n_crossing and the document's doc_tokens. Sections are lines, or
    with `ends_col` (arrays of character ends) fields."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    held = to_tasks(docs.sparkSession, vocabulary_bytes(vocabulary))  # a megabyte or so, bounded by the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = tokenizer(held())
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                row, cols = [], [[] for _ in range(6)]
                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py() or ""
                    raw = text.encode("utf-8")
                    ids = encoder.encode_to_numpy(text, disallowed_special=())
                    ends = line_ends(raw) if ends_col is None else field_ends(raw, batch.column(2)[i].as_py())
                    counts, crossing = attribute(ends, size[ids], rule)
                    chars = ends if len(raw) == len(text) else np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)][ends]
                    row.append(np.full(len(ends), i))
                    for to, part in zip(cols, (np.arange(len(ends)), np.r_[0, chars[:-1]], chars, counts, crossing, np.full(len(ends), len(ids))), strict=True):
                        to.append(part)
                taken = batch.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    rows = with_ids(docs, id_col, text_col) if ends_col is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(ends_col).cast("array<long>").alias("ends"))
    return rows.mapInArrow(run, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(read(spark, sf_dir, "documents"))

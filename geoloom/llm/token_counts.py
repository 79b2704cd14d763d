"""Token counts by overlap resynchronisation.

A text longer than one chunk is never encoded at once.  Overlapping chunks are encoded with
offsets and spliced where a boundary is proven stable:

* the pre-tokeniser has no look-behind, so from a true boundary on, its matches depend only on
  what follows;
* a chunk that starts at a true boundary therefore has only true boundaries, up to a margin
  before its right end (a match there could look past the end);
* if the next, overlapping chunk has a boundary at the same place, its tokens from there on are
  the tokens of the whole text.

If an overlap has no common boundary (one very long word, say), it is widened until it has one;
at the latest it starts where the chunk before does, and is then right by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import env_single_thread, keyed_texts, map_arrow, record_batch, text_blocks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"
#: Characters before a chunk's right end in which its boundaries aren't relied on: longer than
#: any special token's string and than what the pre-tokeniser looks ahead.
MARGIN = 64
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        env_single_thread()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def word_starts(encoding, shift: int) -> dict[int, int]:
    """Absolute character position of each pre-token's start: the index of its first token."""
    out, before = {}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != before or word is None:
            out[shift + start] = k
        before = word
    return out


def count_spliced(encode, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """(tokens, chunks encoded) of text; encode(str) gives an encoding with offsets and word ids."""
    n, chunks = len(text), 1
    begin, end = 0, min(chunk, n)
    enc = encode(text[begin:end])
    starts, first, total = word_starts(enc, begin), 0, 0  # tokens before `first` are counted
    grow, unbroken = chunk // 2, False
    while end < n:
        width = overlap
        while True:
            left = max(begin, end - width)
            # after a stretch without boundaries a short probe comes first, and a stretch that goes on doubles
            right = min(n, end + overlap if unbroken and left > begin else max(left + chunk, end + grow))
            nxt = encode(text[left:right])
            chunks += 1
            after = word_starts(nxt, left)
            common = [p for p in after if left < p <= end - MARGIN and p in starts and starts[p] >= first]
            if left == begin:
                # the wider chunk starts at a true boundary itself
                cut, skip = first, after_begin(starts, after, first)
                break
            if common:
                p = common[len(common) // 2]
                cut, skip = starts[p], after[p]
                break
            width *= 2
        unbroken = left == begin
        grow = 2 * grow if unbroken else chunk // 2
        total += cut - first
        begin, end, starts, first = (left, right, after, skip)
        enc = nxt
    return total + len(enc.ids) - first, chunks


def after_begin(starts: dict[int, int], after: dict[int, int], first: int) -> int:
    """The token of the wider chunk that stands where token `first` of the earlier one does."""
    at = next((p for p, k in starts.items() if k == first), None)
    return after[at] if at is not None else 0


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk_chars: int = 16384, overlap_chars: int = 1024) -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty
    table gives an empty result; columns other than doc_id and text are ignored.  A narrow map: no
    shuffle, and a task holds one batch of short texts or one chunk of a long one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())])
        tok = tokenizer(tokenizer_path)
        encode = lambda s: tok.encode(s, add_special_tokens=False)
        for ids, texts in text_blocks(batches, 1 << 20):
            counts, chunks = [0] * len(texts), [1] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk_chars]
            for k, e in zip(short, tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False)):
                counts[k] = len(e)
            for k, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[k], chunks[k] = count_spliced(encode, t, chunk_chars, overlap_chars)
            yield record_batch(schema, ids, [len(t.encode()) for t in texts], counts, [c > limit for c in counts], chunks)

    return map_arrow(keyed_texts(docs), run, SCHEMA)

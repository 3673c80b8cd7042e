"""Packing: cost-balanced assignment of documents to sequences of fixed token capacity.

A document's cost is linear in its tokens plus quadratic in them (attention inside the document). Within a
block of documents the fewest sequences that hold its tokens are opened; documents go in descending length
to the sequence of lowest cost that has room. Where none has, as much as fits goes to the sequence with
most room and the rest goes on as a piece of its own. So a block wastes less than one sequence.

A block is what one Spark task has read, up to `block_tokens` tokens, so that nothing is shuffled and no
task holds more than a block; the ids of a sequence tell its task and its place there.

Edge cases: null and empty texts are one token, the end token; repeated documents are packed as often as
they occur; an empty table gives no rows; extra columns are ignored. Where a text spells an added token,
that is the token, as in the tokenizer file.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Sequence ids: the task's number, then this many bits for the place in the task.
_PLACE_BITS = 36


@functools.cache
def tiktoken_ids(ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level BPE given as ranks; the vocabulary is the one of byte_bpe_50k.json."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.asarray(encoding.encode_ordinary(text), np.uint32)


@functools.cache
def tokenizer() -> Callable[[str], np.ndarray]:
    """The public 50k byte-level BPE, found on the machine where it is called."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = tiktoken_ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    added = [x.content for x in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in added):  # the ranks don't have them
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return plain(text)

    return encode


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of the given lengths."""
    n = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        out.append((doc, start, length, seq, capacity - int(room[seq])))
        room[seq] -= length
        cost[seq] += linear * length + quadratic * length * length

    pieces = [(capacity, k, s * capacity) for k, x in enumerate(lengths) for s in range(int(x) // capacity)]
    pieces += [(int(x) % capacity, k, int(x) // capacity * capacity) for k, x in enumerate(lengths) if x % capacity]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    full = sum(p[0] == capacity for p in pieces)
    for seq, (length, k, start) in enumerate(pieces[:full]):
        put(k, start, length, seq)  # the empty sequences all cost nothing
    for length, k, start in pieces[full:]:
        while length:
            fits = np.where(room >= length, cost, np.inf)
            seq = int(fits.argmin())
            part = length
            if fits[seq] == np.inf:
                seq = int(room.argmax())
                part = min(length, int(room[seq]))
            put(k, start, part, seq)
            start, length = start + part, length - part
    return out


def pack(documents: DataFrame, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1_000_000, encoder: Callable = tokenizer, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(), np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << _PLACE_BITS
        docs: list = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal first, docs, tokens
            pieces = assign(np.array([len(x) for _, x in docs], np.int64), capacity)
            own = [docs[k][1][s : s + n].astype("<u4") for k, s, n, _, _ in pieces]
            rows = [(docs[k][0], s, n, zlib.crc32(x.tobytes()), len(docs[k][1]), first + seq, at) for (k, s, n, seq, at), x in zip(pieces, own)]
            first += 1 + max(p[3] for p in pieces)
            docs, tokens = [], 0
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})
            return out.assign(ids=[x.astype(np.int32) for x in own]) if with_ids else out

        for b in batches:
            for doc_id, text in zip(b.doc_id, b.text):
                ids = np.concatenate([encode(text or ""), end])
                docs.append((None if pd.isna(doc_id) else int(doc_id), ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    return documents.select("doc_id", "text").mapInPandas(run, schema + ", ids array<int>" * with_ids)

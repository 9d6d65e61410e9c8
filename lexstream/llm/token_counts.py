"""Operator 8: exact token counts at every prefix by dynamic programming over prefixes.

No token of the vocabulary spans ASCII white space, and white space itself gives none, so with the
chunks c1 .. cn between white space the counts follow ``count[k] = count[k - 1] + tokens(ck)``.  The
table of a document holds tokens(ck) for every k; a prefix that ends inside a chunk adds the count of
that one cut chunk.  Texts are never encoded again to answer truncation or budget questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table, utf8

VOCABULARY = "word_bpe_49k.json"
#: Chunks whose counts a Python worker remembers, and the bytes of the longest one: 50 MB at most.  Beyond that it starts anew.
MEMO, MEMO_CHUNK = 1 << 18, 64


def counter(vocabulary: str) -> Callable[[list[bytes]], list[int]]:
    """Counts of chunks, as the tokenizers library gives them; remembered in the process, so in a worker across tasks."""
    import os
    import sys

    held = sys.modules.setdefault(f"_token_memo_{vocabulary}", {})
    if "count" in held:
        return held["count"]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    memo: dict[bytes, int] = {}

    def count(chunks: list[bytes]) -> list[int]:
        # Long chunks, such as whole texts of a script without spaces, are rarely met again and not remembered.
        here: dict[bytes, int] = {}
        new = list({c for c in chunks if c not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set(chunks))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            found = tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            here.update(zip(part, map(len, found)))
        out = [here[c] if c in here else memo[c] for c in chunks]
        memo.update((c, n) for c, n in here.items() if len(c) <= MEMO_CHUNK)
        return out

    held["count"], held["memo"] = count, memo
    return count


def _packed(counts: np.ndarray) -> bytes:
    """One byte a chunk; a chunk of 255 tokens and more takes 255 and four bytes."""
    if not len(counts) or counts.max() < 255:
        return counts.astype(np.uint8).tobytes()
    return b"".join(bytes([c]) if c < 255 else b"\xff" + int(c).to_bytes(4, "little") for c in counts.tolist())


def unpacked(packed: bytes) -> np.ndarray:
    """Token counts of the chunks of a document."""
    raw = np.frombuffer(packed, np.uint8)
    if not len(raw) or raw.max() < 255:
        return raw.astype(np.int64)
    out, i = [], 0
    while i < len(packed):
        if packed[i] < 255:
            out.append(packed[i])
            i += 1
        else:
            out.append(int.from_bytes(packed[i + 1 : i + 5], "little"))
            i += 5
    return np.array(out, np.int64)


def tokens_of_prefix(text: str, packed: bytes, end: int, vocabulary: str = VOCABULARY) -> int:
    """Exact token count of ``text[:end]``; encodes at most the chunk that the cut goes through."""
    head = text[:end].encode().split()
    whole = unpacked(packed)
    if not head:
        return 0
    k = len(head)
    cut = 0 < end < len(text) and not text[end - 1 : end].encode().isspace() and not text[end : end + 1].encode().isspace()
    return int(whole[: k - 1].sum()) + (counter(vocabulary)([head[-1]])[0] if cut else int(whole[k - 1]))


def prefix_within(text: str, packed: bytes, budget: int) -> int:
    """Code points of the longest prefix that ends with a chunk and has no more tokens than the budget."""
    k = int(np.searchsorted(np.cumsum(unpacked(packed)), budget, side="right"))
    raw, at = text.encode(), 0
    for chunk in raw.split()[:k]:
        at = raw.index(chunk, at) + len(chunk)
    return len(raw[:at].decode())


def token_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_bytes, n_tokens, prefixes) for every row.

    ``prefixes`` is the packed count table.  Null and empty texts have 0 bytes, 0 tokens and an empty
    table; repeated rows come back as often as they occur; other columns are not read.  One pass, no
    shuffle; a batch is cut into runs of 256 documents, so memory stays bounded by the longest texts.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count = counter(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                chunks = [t.split() if t else [] for t in texts]
                counts = np.array(count([c for cs in chunks for c in cs]), np.int64)
                ends = np.cumsum([len(cs) for cs in chunks])
                total = np.concatenate([[0], np.cumsum(counts)])
                starts = ends - [len(cs) for cs in chunks]
                yield {
                    "id": part.column(0), "n_bytes": [len(t) if t else 0 for t in texts],
                    "n_tokens": total[ends] - total[starts],
                    "prefixes": [_packed(counts[a:b]) for a, b in zip(starts, ends)],
                }

    kind = dict(docs.dtypes)[id_col]
    return arrow_pass(
        docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), step,
        f"id {kind}, n_bytes long, n_tokens long, prefixes binary",
    ).withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf: str, limit: int = 2048) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    found = token_prefixes(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

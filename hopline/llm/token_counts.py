"""Token counts by a two-tier lookup on the map side.

Tier 1 is a broadcast table of the token counts of frequent pre-tokens, bounded in entries. Tier 2 is a cache in each Python worker for the rest,
filled by the tokenizer itself. No pre-token is ever shuffled: to find the frequent ones, each task sends a bounded list of its heaviest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hopline.llm.chunks import cut

#: Entries of the broadcast table (some 3 MB), of the list that a task sends, and of the counters and caches of a worker.
FREQUENT, PER_TASK, COUNTER, CACHE = 1 << 16, 1 << 13, 1 << 17, 1 << 19
#: Places of the table of what was seen once.
SEEN = 1 << 22
#: Pre-tokens longer than this are encoded each time, so that a cache has a bound in bytes.
LONGEST = 64

# Fixed value: the pre-token pattern of the byte-level tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# byte-level models see each byte as a printable character: itself if it is one, else a letter from U+0100 on
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_CHARS = {b: (chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b))) for b in range(256)}

_workers: dict[str, "PreTokens"] = {}


class Memo(dict):
    """A bounded dict that takes a key in when it is offered for the second time, so that what occurs once does not fill it.

    What was offered once is a mark in a small table, cleared when an eighth of it is marked; a key that meets a mark of another only enters early.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.offers, self.seen = most, 0, bytearray(SEEN)

    def offer(self, key: str, value) -> None:
        if len(key) > LONGEST or len(self) >= self.most:
            return
        at = hash(key) % SEEN
        if self.seen[at]:
            self[key] = value
            return
        self.seen[at] = 1
        self.offers += 1
        if self.offers >= SEEN // 8:
            self.offers, self.seen = 0, bytearray(SEEN)


class PreTokens:
    """A tokenizer file in a worker, with what has been learnt about its pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model.tokenize
        self.cache = Memo(CACHE)

    @classmethod
    def get(cls, path: str) -> "PreTokens":
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def whole(self, text: str) -> list[int]:
        """Ids of any text."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, token: str) -> list[int]:
        """Ids of one pre-token, by the library's model."""
        return [t.id for t in self.model(token.encode().decode("latin-1").translate(_BYTE_CHARS))]

    def length(self, token: str, frequent: dict[str, int]) -> int:
        """Tier 1, tier 2, the tokenizer."""
        n = frequent.get(token) or self.cache.get(token)
        if n is None:
            n = len(self.encode(token))
            self.cache.offer(token, n)
        return n

    def counts(self, texts: pa.Array, frequent: dict[str, int]) -> np.ndarray:
        """Tokens of each of a batch of non-null texts."""
        out = np.zeros(len(texts), np.int64)
        for c in cut(texts, self.special, self.find):
            for r in c.whole.tolist():
                out[c.first + r] = len(self.whole(c.texts[r].as_py()))
            lengths = np.fromiter((self.length(t, frequent) for t in c.tokens), np.int64, len(c.tokens))
            sums = np.concatenate([[0], np.cumsum(lengths[c.index])])[c.bounds]
            out[c.first + c.plain] = np.diff(sums)
        return out


def _heaviest(counts: Counter, n: int) -> Counter:
    return Counter(dict(counts.most_common(n)))


def frequent_pre_tokens(docs: DataFrame, path: str, text_col: str = "text", n: int = FREQUENT) -> DataFrame:
    """(token, n): about the ``n`` most frequent pre-tokens of all documents, by the heaviest of each task (a bounded counter, pruned when full).

    Texts that go to the tokenizer whole do not count here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = PreTokens.get(path), Counter()
        for batch in batches:
            for c in cut(batch.column("text"), own.special, own.find):
                counts.update(dict(zip(c.tokens, np.bincount(c.index, minlength=len(c.tokens)).tolist(), strict=True)))
                if len(counts) > COUNTER:
                    counts = _heaviest(counts, COUNTER // 4)
        top = [(t, k) for t, k in counts.most_common(PER_TASK) if k > 1 and len(t) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], ["token", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is the tokenizer's file. Counts are those of encode(text, add_special_tokens=False): no truncation, special strings in a text are
    one token each. A null text counts as empty (0 tokens), a null id stays null, repeated rows are counted each for itself, other columns are
    ignored. The frequent table only saves work: an absent or stale entry changes no count. Very long texts are handled whole.
    """
    spark = docs.sparkSession
    top = [r["token"] for r in frequent_pre_tokens(docs, path, text_col).select("token").toLocalIterator()]
    lengths = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(top, add_special_tokens=False)]
    table = spark.sparkContext.broadcast(dict(zip(top, lengths, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = PreTokens.get(path), table.value
        for batch in batches:
            counts = own.counts(batch.column("text"), frequent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

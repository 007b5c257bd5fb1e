"""Byte-level BPE by a global shuffle of distinct words.

1. A task splits its documents into pre-tokens and numbers the distinct ones
   of a block (some 16 MB of text). A document becomes its positions: the
   packed list of word numbers, the commonest word having the least.
2. The distinct words of all blocks are dealt by a hash of the word, packed
   by bucket. Every word meets its copies there and is encoded once.
3. The ids go back to their block, where the documents' lists turn them into
   token ids, in order.

Exploding single tokens with (document, position) gives the same join at some
four times the shuffled bytes; here only words travel, and positions stay
packed with their document. Decoding joins the ids with the token-byte table
(the vocabulary, of fixed size, loaded by every worker).

Defined cases: null text is the empty text with no ids; very long texts and
words are whole; repeated rows and null ids are rows of their own; an empty
table gives an empty result; further columns are carried only where named.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scratch import new_folder

#: Characters of text in a block; blocks end with the document that reaches it.
BLOCK_CHARS = 16 << 20
#: Buckets of distinct words at most, so that a block's words of one bucket are still a list worth packing.
MOST_BUCKETS = 1 << 13
_DOC, _ORDER = -2, -1
_PACKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ordinal", T.IntegerType()), T.StructField("payload", T.BinaryType())])


@lru_cache(maxsize=4)
def token_bytes(vocab_path: str) -> list[bytes]:
    """The token-byte table: bytes of every id."""
    with open(vocab_path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@lru_cache(maxsize=4)
def encoder(vocab_path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(token_bytes(vocab_path)) if b}, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern with \s as the property White_Space, as the encoder's library reads it."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


@lru_cache(maxsize=4)
def newer_letters(vocab_path: str, pattern: str) -> tuple[str, re.Pattern]:
    """Letters and numbers of a newer Unicode than the encoder's library has, the least of them first; to it they are signs.

    A sign joins the apostrophe after it, a letter leaves it to the
    contraction, so what the library makes of the pair tells which it is.
    """
    turn = encoder(vocab_path, pattern).encode_ordinary
    apart = turn("'s")
    known = regex.compile(r"[\p{L}\p{N}]")
    large = ((0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xD800, 0xE000), (0x20000, 0x2A6D7))
    new = [c for c in map(chr, (x for x in range(0x80, 0x32400) if not any(a <= x < b for a, b in large))) if known.match(c) and turn(c + "'s")[-len(apart) :] != apart]
    if not new or len(apart) != 1:
        return chr(0x10FFFF), re.compile(r"(?!)")
    return new[0], re.compile("[" + "".join(map(re.escape, new)) + "]")


def pre_tokens(text: str, vocab_path: str, pattern: str) -> Iterator[list[str]]:
    """Lists of pre-tokens, in order; very long texts in several."""
    p, seen = splitter(pattern), text
    if not text.isascii():
        least, newer = newer_letters(vocab_path, pattern)
        if max(text) >= least:
            seen = newer.sub("\u00a4", text)
    if len(text) < 1 << 22 and seen == text:
        yield p.findall(text)
        return
    found = (text[m.start() : m.end()] for m in p.finditer(seen))
    while part := list(islice(found, 1 << 20)):
        yield part


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, deflated: the high planes are nearly all zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _lists(items: list[bytes]) -> bytes:
    return zlib.compress(len(items).to_bytes(4, "little") + np.fromiter(map(len, items), "<u4", len(items)).tobytes() + b"".join(items), 1)


def _unlists(data: bytes) -> tuple[np.ndarray, bytes]:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<u4", n, 4), data[4 + 4 * n :]


class _Block:
    """Pre-tokens of some documents, numbered."""

    def __init__(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.docs: list[tuple] = []
        self.chars = 0

    def add(self, keys: tuple, text: str, vocab_path: str, pattern: str) -> None:
        parts = [np.fromiter(map(self.number.__getitem__, p), np.int32, len(p)) for p in pre_tokens(text, vocab_path, pattern)]
        self.docs.append((keys, parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int32), *parts])))
        self.chars += len(text)

    def rows(self, block: int, buckets: int, names: list[str]) -> Iterator[pd.DataFrame]:
        lists = [x for _, x in self.docs]
        used = np.bincount(np.concatenate(lists), minlength=len(self.number)) if self.number else np.zeros(0, int)
        order = np.argsort(-used, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for at in range(0, len(self.docs), 2000):
            part = self.docs[at : at + 2000]
            out = pd.DataFrame({"block": block, "bucket": _DOC, "ordinal": range(at, at + len(part)), "payload": [_squeeze(rank[x]) for _, x in part]})
            for i, name in enumerate(names):
                out[name] = pd.Series([k[i] for k, _ in part], dtype=object)
            yield out
        spelled = list(self.number)
        words = [spelled[i].encode("utf-8") for i in order.tolist()]
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        # The stable order by bucket is how the buckets' lists follow one another.
        by = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[by], prepend=-1, append=-1))
        packed = [(int(of[by[a]]), _lists([words[i] for i in by[a:b].tolist()])) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(words) else []
        yield pd.DataFrame({"block": block, "bucket": [_ORDER, *(b for b, _ in packed)], "ordinal": 0, "payload": [_squeeze(of), *(p for _, p in packed)]} | dict.fromkeys(names))


#: What becomes of a document's ids: names and types of columns, and their values.
Finish = Callable[[np.ndarray], tuple]


def encode(docs: DataFrame, vocab_path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a document: the carried columns, n_tokens and ids (little-endian unsigned 32-bit)."""
    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return _encoded(docs, vocab_path, pattern, carry, made, lambda ids: (len(ids), ids.tobytes()))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of column block, so that it is joined by block where it lies."""
    spark, name = df.sparkSession, f"bpe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", new_folder(spark, "bpe-words")).saveAsTable(name)
    out = spark.table(name)
    _ = out.schema  # resolved: files and buckets are known, the name isn't needed again
    spark.sql(f"DROP TABLE {name}")
    return out


def _encoded(docs: DataFrame, vocab_path: str, pattern: str, carry: tuple[str, ...], made: T.StructType, finish: Finish) -> DataFrame:
    names = [f"__c{i}" for i in range(len(carry))]
    source = docs.select("text", *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    kinds = [T.StructField(n, docs.schema[c].dataType) for c, n in zip(carry, names, strict=True)]
    parts = docs.rdd.getNumPartitions()
    buckets = min(MOST_BUCKETS, max(256, parts))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, block = 0, _Block()
        first = TaskContext.get().partitionId() << 24
        for batch in batches:
            keys = zip(*[batch[n].astype(object).where(batch[n].notna(), None) for n in names], strict=True) if names else [()] * len(batch)
            for key, text in zip(keys, batch["text"], strict=True):
                block.add(key, text or "", vocab_path, pattern)
                if block.chars >= BLOCK_CHARS:
                    yield from block.rows(first + made, buckets, names)
                    made, block = made + 1, _Block()
        if block.docs:
            yield from block.rows(first + made, buckets, names)

    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, known, bucket = encoder(vocab_path, pattern).encode_ordinary, {}, None
        for batch in batches:
            out = []
            for b, payload in zip(batch["bucket"], batch["payload"], strict=True):
                if b != bucket:
                    bucket, known = b, {}
                sizes, data = _unlists(payload)
                ends = np.cumsum(sizes).tolist()
                got = []
                for a, z in zip([0, *ends], ends, strict=False):
                    word = data[a:z]
                    if (ids := known.get(word)) is None:
                        ids = known[word] = np.array(turn(word.decode("utf-8")), "<u4").tobytes()
                    got.append(ids)
                out.append(_lists(got))
            yield batch.assign(payload=out)

    def assemble(_: tuple, rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("bucket")
        got = [_unlists(p) for p in words["payload"]]
        special = rows["bucket"] == _ORDER
        of = _unsqueeze(rows.loc[special, "payload"].iloc[0])
        rows = rows[~special].sort_values("ordinal")
        by = np.argsort(of, kind="stable")
        sizes, starts = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        flat = np.frombuffer(b"".join(d for _, d in got), "<u4")
        sizes[by] = np.concatenate([s for s, _ in got]).astype(np.int64) // 4 if got else 0
        starts[by] = np.concatenate(([0], np.cumsum(sizes[by])[:-1])) if len(of) else 0
        values = []
        for payload in rows["payload"]:
            ranks = _unsqueeze(payload)
            long = sizes[ranks]
            shift = starts[ranks] - np.concatenate(([0], np.cumsum(long)[:-1])) if len(ranks) else long
            values.append(finish(flat[np.repeat(shift, long) + np.arange(long.sum())]))
        out = {k: rows[k].astype(object).where(rows[k].notna(), None).tolist() for k in names}
        return pd.DataFrame(out | {f.name: [v[i] for v in values] for i, f in enumerate(made)})

    packed = _bucketed(source.mapInPandas(split, T.StructType([*_PACKED.fields, *kinds])), min(4096, max(8, 2 * parts)))
    words = packed.filter("bucket >= 0").select("block", "bucket", "payload").repartition("bucket").sortWithinPartitions("bucket")
    words = words.mapInPandas(encode_words, "block long, bucket int, payload binary")
    rows = packed.filter("bucket < 0")
    return rows.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(assemble, T.StructType([*kinds, *made.fields])).withColumnsRenamed(dict(zip(names, carry, strict=True)))


def joined_bytes(ids: np.ndarray, vocab_path: str) -> bytes:
    """The ids joined with the token-byte table."""
    return b"".join(map(token_bytes(vocab_path).__getitem__, ids.tolist()))


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``encoded`` with column decoded, the bytes of its ids."""

    @F.pandas_udf(T.BinaryType())
    def join_bytes(column: pd.Series) -> pd.Series:
        return pd.Series([joined_bytes(np.frombuffer(ids, "<u4"), vocab_path) for ids in column])

    return encoded.withColumn("decoded", join_bytes("ids"))


def round_trip(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Ids are decoded in the task that has joined them, and only digests leave it.
    """

    def digests(ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(joined_bytes(ids, vocab_path)).hexdigest()

    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _encoded(docs, vocab_path, pattern, ("doc_id",), made, digests)

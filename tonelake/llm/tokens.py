"""Token counts through a digest cache, and the encoder that packing uses too.

A text's count is stored under the digest of its normalised content and the digest of the tokenizer's
file. A run joins the digests of all texts to the cache, encodes one text of each digest that is
missing, appends the counts, and joins them back.

Normalised content is the text's UTF-8 with null as empty: all that a tokenizer's own normaliser may
change is left to it, so equal digests always mean equal counts. Another tokenizer file has another
digest and never meets old counts.

Defined results: null and empty texts have 0 tokens; each repeated row gets its row; ids may be null or
repeat; an empty table gives an empty table; other columns are not read. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, map_batches, n_bytes, settle, texts
from tonelake.session import shared_folder

#: Fixed value: how a byte-level file splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_sign() -> dict[str, int]:
    """Byte-level files write a byte that prints as itself, and the others, in order, as signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _specials(spec: dict) -> list[str]:
    return [t["content"] for t in spec.get("added_tokens", [])]


def _is_byte_bpe(spec: dict) -> bool:
    """Whether the file is plain byte-level BPE whose ids are in the order of its merges."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if not plain or model.get("type") != "BPE" or any(odd):
        return False
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level file; none for its special tokens."""
    spec, byte = _spec(path), _byte_of_sign()
    special = set(_specials(spec))
    out = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for token, i in spec["model"]["vocab"].items():
        out[i] = b"" if token in special else bytes(byte[c] for c in token)
    return out


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The file's vocabulary as ranks: the same ids for text without special strings, several times faster."""
    import tiktoken

    ranks = {token: i for i, token in enumerate(byte_tokens(path)) if token}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def library(path: str):
    """The file in its own library, which takes some memory and is loaded on first use."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the file's own library gives them.

    Plain byte-level files are encoded by ranks; texts with special strings, and all other files, by the
    file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.specials: list[str] = []
        self.ranks = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda text: model.encode(text, num_threads=1)
        else:
            self._ids = lambda text: library(path).encode(text, add_special_tokens=False).ids
            spec = _spec(path)
            self.specials = _specials(spec)
            self.ranks = byte_bpe(path) if _is_byte_bpe(spec) else None

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.ranks is None or any(s in text for s in self.specials):
            return self._ids(text)
        return self.ranks.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.ids(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


class TokenCache:
    """Stored counts: a folder of Parquet files to which runs only append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, tokenizer: str) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")

    def append(self, counts: DataFrame, tokenizer: str) -> None:
        counts.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, cache: TokenCache, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``.

    Digests are reduced before the shuffle, so copies meet as one row each. Whole texts move once, by
    digest and id, where repeated rows lie together; one text of each digest that the cache lacks is encoded.
    """
    tokenizer = file_digest(path)
    content = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].alias("doc_id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    source = source.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keys = source.select("doc_id", "id", "digest", n_bytes(F.col("text")).alias("n_bytes"))
    first = keys.groupBy("digest").agg(F.min("id").alias("id"))
    missing = settle(first.join(cache.read(tokenizer), "digest", "left_anti"), "missing-digests")
    todo = source.join(missing, ["digest", "id"], "left_semi").select("digest", "id", "text").dropDuplicates(["digest", "id"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(path).ids
        counts = [len(ids(t)) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    cache.append(map_batches(todo, count, "digest binary, n_tokens long"), tokenizer)
    # Runs side by side may store a digest twice.
    counts = settle(cache.read(tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    cache = TokenCache(spark, os.path.join(shared_folder(spark), "token-cache"))
    out = count_tokens(documents(spark, sf_dir), cache, tokenizer_path("byte_bpe_50k.json"))
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))

"""A whole corpus as ids of a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's own pattern inside Spark. Each distinct
word of the corpus is encoded once; the ids are joined to the blocks of texts that use
the word and put back by position. Texts travel once, words once per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_CHARS = 2_000_000

# White space by code point, and the vocabulary's pattern for words.
BLANK = r"\t-\r \x85\xA0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


@lru_cache(2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    t.encode_special_tokens = True
    return t


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value)
        for b in batches:
            ids = [e.ids for e in t.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
    """texts: block, key, words; dictionary: block, word, ids -> key, ids."""
    words = texts.column("words").combine_chunks()
    words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(words)
    names, ids = dictionary.column("word").combine_chunks(), dictionary.column("ids").combine_chunks()
    if isinstance(names, pa.ChunkedArray):
        names, ids = pa.concat_arrays(names.chunks), pa.concat_arrays(ids.chunks)
    at = pc.index_in(flat, value_set=names)
    if at.null_count:
        raise ValueError("a word has no entry")
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    at = at.to_numpy(zero_copy_only=False).astype(np.int64)
    each = lengths[at]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) - np.repeat(ends - each, each) + np.repeat(starts[at], each)
    values = pc.list_flatten(ids).to_numpy(zero_copy_only=False)[source] if total else np.zeros(0, np.int32)
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.table({"key": texts.column("key"), "ids": pa.ListArray.from_arrays(pa.array(upto), pa.array(values, pa.int32()))})


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row; an empty and a null text both give an empty list.

    Special tokens are never added, and their strings are ordinary text. ``vocabulary`` is a
    file that the driver reads; its text (of fixed size) is what the workers get.
    A block is as many texts as make about ``block_chars`` characters, chosen by a hash of the key.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chars = docs.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).repartition("block")
    docs = docs.select("block", "key", F.regexp_extract_all("t", F.lit(WORDS), 0).alias("words"))
    used = cut(docs.select("block", F.explode("words").alias("word")).distinct())  # read twice below
    encoded = used.select("word").distinct().mapInArrow(_encoder(shared), "word string, ids array<int>")
    dictionary = used.join(encoded, "word").select(F.col("block").alias("at_block"), "word", "ids")
    out = docs.groupBy("block").cogroup(dictionary.groupBy("at_block")).applyInArrow(_assemble, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decoded_texts(ids: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """``key`` and ``text`` for rows of ``token_ids``: each id is joined to its piece, the pieces put together in order.

    The table of pieces has the vocabulary's fixed size, so it is broadcast. An empty list gives an empty text.
    Keys must be unique.
    """
    spark = ids.sparkSession
    with open(ranks, "rb") as f:
        pieces = [(int(n), base64.b64decode(p).hex()) for p, n in map(bytes.split, f)]
    vocab = F.broadcast(spark.createDataFrame(pieces, "id int, piece string"))
    each = ids.select(key, F.posexplode_outer("ids").alias("at", "id")).join(vocab, "id", "left")
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
    return whole.select(key, F.decode(F.unhex(F.array_join(F.transform("ps", lambda p: p["piece"]), "")), "UTF-8").alias("text"))

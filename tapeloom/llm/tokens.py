"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

A document becomes its pre-tokens with their frequencies. Pre-tokens of a bounded sample of documents
are counted first and handed to every task (a broadcast of proven size, as very frequent pre-tokens occur
in any sample); the others are shuffled, made distinct, counted once each and joined back by pre-token.
The sample decides only which way a pre-token takes, never its count.
"""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.sources import read_table, written

#: About so many documents, drawn at random, show which pre-tokens are frequent; the most pre-tokens handed out.
HOT_DOCUMENTS = 8_000
HOT_PRETOKENS = 300_000
#: Longer pre-tokens always take the shuffled way.
HOT_CHARS = 32
LIMIT = 512


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    """Splits texts as the tokenizer does: at the strings of its special tokens, then by its pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str | None) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens the text spells out."""
        if not text:
            return [], 0
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        return self.find(parts[0]) if len(parts) == 1 else [p for part in parts for p in self.find(part)], len(parts) - 1


@functools.lru_cache(maxsize=2)
def pretokens(path: str, pattern: str) -> PreTokens:
    return PreTokens(path, pattern)


def count_pieces(path: str, pieces: list[str]) -> list[int]:
    """Number of tokens of each pre-token."""
    return [len(e.ids) for e in _tokenizer(path).encode_batch(pieces, add_special_tokens=False)]


def _counted(distinct: DataFrame, path: str) -> DataFrame:
    """``pretoken`` with ``pieces``, its number of tokens."""
    return map_texts(distinct, ["pretoken"], "pretoken", lambda texts: {"pieces": count_pieces(path, texts)}, "pieces int")


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Tokens of every row: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``).

    A null text counts as empty (0 bytes, 0 tokens). Repeated and null ids are kept row by row, further
    columns are left out, an empty table gives an empty result. Strings of special tokens inside a text
    count as one token each, the library's default.
    """
    source = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))

    def sample_split(texts: list) -> dict:
        split = pretokens(path, pattern)
        return {"found": [list({p for p in split(t)[0] if len(p) <= HOT_CHARS}) for t in texts]}

    share = min(1.0, HOT_DOCUMENTS / max(1, source.count()))  # limit() would shuffle that many whole texts of every task
    sampled = map_texts(source.sample(share, seed=7), [], "__text", sample_split, "found array<string>")
    hot_rows = _counted(
        sampled.select(F.explode("found").alias("pretoken")).groupBy("pretoken").count().orderBy(F.desc("count"), "pretoken").limit(HOT_PRETOKENS), path
    ).collect()
    hot = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in hot_rows})

    def frequencies(texts: list) -> dict:
        split, known = pretokens(path, pattern), hot.value
        n_hot, cold, freq = [], [], []
        for t in texts:
            found, special = split(t)
            counts = Counter(found)
            cold.append([p for p in counts if p not in known])
            n_hot.append(special + sum([known[p] * n for p, n in counts.items() if p in known]))
            freq.append([counts[p] for p in cold[-1]])
        return {"n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_hot": n_hot, "cold": cold, "freq": freq}

    rows = source.withColumn("__row", F.monotonically_increasing_id())
    docs = written(map_texts(rows, ["__row", "__id"], "__text", frequencies, "n_bytes long, n_hot long, cold array<string>, freq array<int>"), "frequencies")
    pairs = docs.select("__row", F.explode(F.arrays_zip("cold", "freq")).alias("p")).select("__row", F.col("p.cold").alias("pretoken"), F.col("p.freq").alias("freq"))
    counted = _counted(pairs.select("pretoken").distinct(), path)
    sums = pairs.join(counted, "pretoken").groupBy("__row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("n_cold"))
    total = F.col("n_hot") + F.coalesce(F.col("n_cold"), F.lit(0))
    return docs.select("__row", "__id", "n_bytes", "n_hot").join(sums, "__row", "left").select(
        F.col("__id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of ``documents``; see :func:`count_tokens` for nulls, repeats and empty tables."""
    import public_tokenizers as vocab

    return count_tokens(read_table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"), vocab.PATTERN)

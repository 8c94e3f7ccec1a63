"""Language identification by compression: the dictionary under which a text gets smallest names its language.

For each language whole texts of a bounded sample of training rows are put together as a zstandard
raw-content dictionary. A text is compressed once per language; the smallest size wins, and the answer
is rejected (``und``) if the runner-up is too close.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.sources import read_table

#: Bounds of the training sample: rows a language, bytes a row, and bytes of a dictionary.
SAMPLE_ROWS = 300
SAMPLE_ROW_BYTES = 16_384
DICTIONARY_BYTES = 131_072
LEVEL = 3
#: Least relative margin between the two smallest sizes; below it the language is rejected.
MARGIN = 0.002
_MARKS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """What is compressed: the text in lower case, each run of marks and digits as one space; empty without a letter.

    Letters are the characters of the letter categories; superscripts, fractions and numerals such as Ⅷ are none.
    """
    found = _MARKS.sub(" ", text.lower()).strip() if text else ""
    return f" {found} ".encode() if any(map(str.isalpha, found)) else b""


def train_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language from at most SAMPLE_ROWS whole texts each.

    Rows with a null text or language and texts beyond SAMPLE_ROW_BYTES are not used. Copies count once: of the different texts
    of a language those with the smallest hashes are taken, so that the choice depends neither on the partitioning nor on how often a text is there.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    rows = rows.where(F.octet_length("text").between(1, SAMPLE_ROW_BYTES)).withColumn("h", F.xxhash64("text"))
    counts = rows.select("lang", "h").distinct().groupBy("lang").agg((F.least(F.lit(1.0), 4 * SAMPLE_ROWS / F.count("*")) * (1 << 30)).cast("long").alias("most"))
    # about 4 * SAMPLE_ROWS texts a language pass by their hash, whatever the size of the table, and each once; the ranks choose among them
    rows = rows.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("most")).dropDuplicates(["lang", "h"]).drop("most")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= SAMPLE_ROWS)
    made: dict[str, list[bytes]] = {}
    for r in ranked.select("lang", "h", "text").orderBy("lang", "h", "text").collect():
        raw, held = letters(r["text"]), made.setdefault(r["lang"], [])
        if sum(map(len, held)) + len(raw) <= DICTIONARY_BYTES:
            held.append(raw)
    return {lang: b"".join(texts) for lang, texts in sorted(made.items())}


@functools.lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard

    out = []
    for lang, raw in dictionaries:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, dictionaries: tuple, level: int = LEVEL) -> tuple[str, float]:
    """The language of the smallest compressed size, and the relative margin to the next size.

    A text that is null or has no letter gives ``und`` and 0. Equal sizes go to the language that is first
    in alphabetical order.
    """
    raw = letters(text)
    if not raw:
        return "und", 0.0
    sizes = sorted((len(c.compress(raw)), lang) for lang, c in _compressors(dictionaries, level))
    if not sizes:
        return "und", 0.0
    return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], key_cols: list | None = None, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Key columns, ``lang_best``, ``score`` (relative margin, 0 to 1) and ``lang`` (``und`` if the margin is below ``margin``).

    Null texts and texts without a letter give ``und`` and 0, and so does everything if nothing was
    learned. Repeated rows are kept, further columns are left out.
    """
    held = tuple(dictionaries.items())
    shared = df.sparkSession.sparkContext.broadcast(held)

    def fn(texts: list) -> dict:
        best, score = zip(*[classify(t, shared.value) for t in texts], strict=True)
        return {"lang_best": best, "score": score, "lang": [b if s >= margin else "und" for b, s in zip(best, score, strict=True)]}

    return map_texts(df, key_cols or ["doc_id"], text_col, fn, "lang_best string, score double, lang string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, learned from rows that are not held out; see :func:`identify_languages` for nulls."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    dictionaries = train_dictionaries(docs.where(~held_out))
    found = identify_languages(docs, dictionaries, ["doc_id", held_out.alias("held_out")])
    return found.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), "score", F.col("lang").alias("lang_or_rejected"))

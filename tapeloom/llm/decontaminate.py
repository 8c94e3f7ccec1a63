"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become lower-case words of letters and digits. A mask looks at SPAN consecutive words and ignores
some of them; the words it sees are hashed together with the mask's number. Hashes of every position of
every document meet the hashes of every position of every benchmark item; as different masks ignore
different places, a passage in which words were exchanged still makes a hit. Items of fewer than SPAN words are
hashed whole and must be met whole. A hit is a document, an item and the word at which the item would begin; only
hits are shuffled, never words, and the words of a document are looked up once. Around each hit item and
document are laid over one another and compared word by word: a match counts 1, an exchanged word
-PENALTY, and the best-scoring stretch is the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.sources import read_table, written

#: Masks over SPAN words: a digit 1 is seen, a 0 ignored.
MASKS = ("1110110111", "1101011011", "1011100111")
SPAN = 10
PENALTY = 2
#: An overlap counts from so many equal words, or from this share of the item where that is fewer.
LEAST_WORDS = 13
LEAST_SHARE = 0.7
#: Items with fewer words name no passage and are not looked for.
LEAST_ITEM_WORDS = 4
#: Benchmark hashes with their items up to this size are broadcast; more are shuffled.
BROADCAST_BYTES = 48 << 20

def words(text: Column) -> Column:
    """Lower-case words of letters and digits; one empty word may come first, null gives no words."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def _hashes(tokens: str, at: str) -> Column:
    """Spaced-seed hashes at position ``at`` (from 0), one for each mask."""
    seen = lambda mask: [F.get(F.col(tokens), F.col(at) + k) for k, c in enumerate(mask) if c == "1"]
    return F.array(*[F.xxhash64(F.lit(n), *seen(m)) for n, m in enumerate(MASKS)])


def seeded(df: DataFrame, tokens: str, at: str, whole: list[int], item: bool = False) -> DataFrame:
    """A row for each position and mask, with ``at`` and ``h``; also for each run of a number of words in ``whole``.

    For an ``item`` a mask is laid where it fits, and only all of its words are a run.
    """
    n = F.size(tokens)
    runs = [F.when(n == k if item else F.col(at) + k <= n, F.xxhash64(F.lit(-k), F.slice(F.col(tokens), F.col(at) + 1, k))) for k in whole]
    masked = F.when(F.col(at) + SPAN <= n, _hashes(tokens, at))
    hashes = F.concat(F.coalesce(masked, F.array().cast("array<long>")), F.array_compact(F.array(*runs))) if runs else masked
    least = min([SPAN, *whole])
    placed = df.where(n >= least).withColumn(at, F.explode(F.sequence(F.lit(0), n - least)))
    return placed.withColumn("h", F.explode(hashes))


def overlap(doc_words: Column, item_words: Column, shift: Column) -> Column:
    """Best stretch (``from``, ``to``, ``equal``) of the item laid at word ``shift`` of the document."""
    low = F.greatest(F.lit(0), -shift)
    n = F.least(F.size(item_words), F.size(doc_words) - shift) - low
    same = F.zip_with(F.slice(doc_words, shift + low + 1, n), F.slice(item_words, low + 1, n), lambda x, y: x == y)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("score"), F.lit(0).alias("equal"), F.lit(0).alias("first"),
        F.struct(F.lit(0).alias("score"), F.lit(0).alias("equal"), F.lit(0).alias("first"), F.lit(0).alias("last")).alias("best"),
    )

    def step(a: Column, s: Column) -> Column:
        fresh = a["score"] <= 0
        score = F.greatest(a["score"], F.lit(0)) + F.when(s, 1).otherwise(-PENALTY)
        equal = F.when(fresh, 0).otherwise(a["equal"]) + F.when(s, 1).otherwise(0)
        first = F.when(fresh, a["i"]).otherwise(a["first"])
        best = F.when(score > a["best"]["score"], F.struct(score.alias("score"), equal.alias("equal"), first.alias("first"), (a["i"] + 1).alias("last"))).otherwise(a["best"])
        return F.struct((a["i"] + 1).alias("i"), score.alias("score"), equal.alias("equal"), first.alias("first"), best.alias("best"))

    best = lambda a: a["best"]
    return F.aggregate(same, start, step, lambda a: F.struct((best(a)["first"] + low).alias("from"), (best(a)["last"] + low).alias("to"), best(a)["equal"].alias("equal")))


def find_overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: the best overlap of the two.

    Columns: ``id_col``, ``item_col``, ``words_equal``, ``item_words``, ``doc_from``, ``item_from``, ``item_to`` (word
    numbers, end exclusive). Of overlaps with equally many words the one earliest in the document counts. Null and empty texts, on
    either side, overlap nothing; items of fewer than SPAN words overlap where all their words stand in a row, those of fewer than
    LEAST_ITEM_WORDS nothing. Repeated ids with one text count as one document, repeated items as one item, rows with a null id or item
    are left out, and so are further columns.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.filter(words(F.col(f"`{item_text}`")), lambda w: w != "").alias("item_words"))
    items = written(items.where(F.col("item").isNotNull() & (F.size("item_words") >= LEAST_ITEM_WORDS)).distinct(), "items").withColumn("n", F.size("item_words"))
    whole = sorted(r[0] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # SPAN numbers at most
    seeds = written(seeded(items, "item_words", "j", whole, True).select("h", "item", "j", "n").distinct(), "seeds")
    bytes_held = seeds.agg(F.coalesce(F.sum(F.octet_length(F.col("item").cast("string")) + 40), F.lit(0))).first()[0]

    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("doc_text")).where("doc is not null")
    # explode() of one element: the words are split once, whatever is made of them
    placed = seeded(docs.select("doc", F.explode(F.array(words(F.col("doc_text")))).alias("doc_words")), "doc_words", "i", whole).select("h", "doc", "i")
    met = placed.join(F.broadcast(seeds) if bytes_held <= BROADCAST_BYTES else seeds, "h")
    hits = written(met.select("doc", "item", "n", (F.col("i") - F.col("j")).alias("shift")).distinct(), "hits")

    by_doc = written(hits.groupBy("doc").agg(F.collect_list(F.struct("item", "n", "shift")).alias("hits")), "asked")
    asked = docs.join(by_doc, "doc").select("doc", "hits", F.explode(F.array(words(F.col("doc_text")))).alias("doc_words"))
    low = lambda h: F.greatest(F.lit(0), h["shift"])
    laid = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["n"].alias("n"), h["shift"].alias("shift"), F.slice("doc_words", low(h) + 1, h["n"] + h["shift"] - low(h)).alias("part")))
    rows = asked.select("doc", F.explode(laid).alias("l")).select("doc", "l.*").distinct().join(items, ["item", "n"])
    # the part begins at the item's first word, or at the document's where the item would begin before it
    shifted = rows.select("doc", "item", "shift", "n", F.explode(F.array(overlap(F.col("part"), F.col("item_words"), F.least(F.lit(0), F.col("shift"))))).alias("o"))
    least = F.when(F.col("n") < SPAN, F.col("n")).otherwise(F.least(F.lit(LEAST_WORDS), F.ceil(LEAST_SHARE * F.col("n"))))
    found = shifted.where(F.col("o.equal") >= least).select("doc", "item", F.struct(F.col("o.equal").alias("equal"), -F.col("shift"), F.col("shift").alias("shift"), "n", F.col("o.from").alias("from"), F.col("o.to").alias("to")).alias("o"))
    best = found.groupBy("doc", "item").agg(F.max("o").alias("o"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("o.equal").alias("words_equal"), F.col("o.n").alias("item_words"),
        (F.col("o.shift") + F.col("o.from")).alias("doc_from"), F.col("o.from").alias("item_from"), F.col("o.to").alias("item_to"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id overlaps no benchmark item; rows with a null id stay."""
    leaks = written(find_overlaps(df, benchmark, id_col, text_col).select(F.col(id_col).alias("__leak")).distinct(), "leaks")
    return df.join(leaks, df[id_col] == leaks["__leak"], "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all ``documents`` with all of ``benchmark``; see :func:`find_overlaps` for nulls, repeats and empty tables."""
    return find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

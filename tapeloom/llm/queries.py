"""Queries of the corpus operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tapeloom.llm.bitslices import BEST, EVERY, SCALE, op11_bit_sliced_top_k
from tapeloom.llm.bpe import op9_byte_bpe
from tapeloom.llm.decontaminate import LEAST_SHARE, LEAST_WORDS, MASKS, PENALTY, SPAN, op1_decontaminate
from tapeloom.llm.html import op7_html_text
from tapeloom.llm.langid import op4_language_id
from tapeloom.llm.merkle import op12_merkle_manifest
from tapeloom.llm.pii import op10_pii
from tapeloom.llm.quality import op8_quality_rules
from tapeloom.llm.simhash import op3_simhash_dedup
from tapeloom.llm.substrings import op6_substring_dedup
from tapeloom.llm.tokens import op5_token_counts
from tapeloom.llm.toxicity import op2_toxicity
from tapeloom.llm.turns import op13_conversation_repair

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_text": op7_html_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pii": op10_pii,
    "op11_bit_sliced_top_k": op11_bit_sliced_top_k,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Every 50-byte window by itself: its smallest document, the runs of bytes under windows that others have first, and what is left.
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
 f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
 c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN f USING (g) WHERE least < doc_id),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) GROUP BY doc_id, run),
 k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
 p AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)"""



def _seen(words: str, at: str) -> str:
    """What each mask sees at a place, as texts: no hashes, so no chance agreement."""
    masks = [" || ' ' || ".join(f"{words}[{at} + {k + 1}]" for k, c in enumerate(mask) if c == "1") for mask in MASKS]
    return "[" + ", ".join(f"'{n} ' || {m}" for n, m in enumerate(masks)) + "]"


#: Overlaps by prefix sums: the best stretch ends where the sum is furthest above its smallest value before. Items of SPAN words or more.
_OVERLAPS = f"""WITH d AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents),
 b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS v FROM benchmark),
 ds AS (SELECT doc_id, i, unnest({_seen("w", "i")}) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - {SPAN - 1})) AS i FROM d WHERE len(w) >= {SPAN})),
 bs AS (SELECT item_id, j, unnest({_seen("v", "j")}) AS h FROM (SELECT item_id, v, unnest(range(len(v) - {SPAN - 1})) AS j FROM b WHERE len(v) >= {SPAN})),
 hit AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM ds JOIN bs USING (h)),
 x AS (SELECT doc_id, item_id, shift, w, v, unnest(range(greatest(0, -shift), least(len(v), len(w) - shift))) AS k FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
 y AS (SELECT doc_id, item_id, shift, len(v) AS n, k, CAST(w[shift + k + 1] = v[k + 1] AS INT) AS same FROM x),
 s AS (SELECT *, sum(CASE WHEN same = 1 THEN 1 ELSE -{PENALTY} END) OVER o AS upto, sum(same) OVER o AS equals FROM y WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY k)),
 p AS (SELECT *, upto - CASE WHEN same = 1 THEN 1 ELSE -{PENALTY} END AS prior, equals - same AS equals_prior FROM s),
 m AS (SELECT *, min(prior) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS low FROM p),
 e AS (SELECT doc_id, item_id, shift, any_value(n) AS n, arg_max(k, (upto - low, -k)) AS stop, arg_max(low, (upto - low, -k)) AS low, arg_max(equals, (upto - low, -k)) AS equals FROM m GROUP BY ALL),
 r AS (SELECT e.doc_id, e.item_id, e.shift, any_value(e.n) AS n, any_value(e.stop) + 1 AS stop, max(p.k) AS start, any_value(e.equals) - arg_max(p.equals_prior, p.k) AS equal
  FROM e JOIN p ON e.doc_id = p.doc_id AND e.item_id = p.item_id AND e.shift = p.shift AND p.k <= e.stop AND p.prior = e.low GROUP BY ALL),
 q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, shift, n DESC, start DESC, stop DESC) AS place FROM r WHERE equal >= least({LEAST_WORDS}, ceil({LEAST_SHARE} * n)))
 SELECT doc_id, item_id, CAST(equal AS INT) AS words_equal, CAST(n AS INT) AS item_words, CAST(shift + start AS INT) AS doc_from, CAST(start AS INT) AS item_from, CAST(stop AS INT) AS item_to FROM q WHERE place = 1"""

#: All scores of all queries, ranked.
_TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {BEST}"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OVERLAPS, "op6_substring_dedup": _REPEATS, "op11_bit_sliced_top_k": _TOP_K}

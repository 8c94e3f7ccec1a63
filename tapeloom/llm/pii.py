"""Personal data: patterns propose spans, checksum validators confirm, nearby context words adjust the score.

Base kinds (fixed contract): email, ip, card, phone; every base span stays. The method adds iban (confirmed by mod-97) and
secret (keys, tokens and passwords: confirmed by a known format or by their mix of characters). Every span has a score: a prior by kind,
raised by a validator that confirms it and by words such as "card" or "password" close to it, lowered by words such as
"version" or "order". A span of an added kind is given out only from a score of LEAST_ADDED on, so a mixed string is a
secret beside "token" and is none beside "commit" or alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.sources import read_table

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

# Possessive quantifiers and look-behinds keep the search linear on long runs; the matches are those
# of the plain patterns, as a later start in a run of digits fails where its first digit fails.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+")
# Leading characters and lengths of keys that some services hand out.
_KNOWN_SECRET = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Score of a proposed span, before and after its validator confirms it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.4, "iban": 0.4, "secret": 0.35}
CONFIRMED = {"email": 0.0, "ip": 0.2, "card": 0.5, "phone": 0.2, "iban": 0.5, "secret": 0.3}
#: Spans of kinds beside the base ones are given out from this score on.
LEAST_ADDED = 0.5
#: Context words and how far around a span they are looked for, in characters.
CONTEXT_CHARS = 40
CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|mobil|fax", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|kennwort|contrase|mot de passe|api.?key|bearer|credential", re.I),
}
COUNTER_CONTEXT = re.compile(r"version|order|invoice|isbn|serial|build|commit|checksum|revision", re.I)
CONTEXT_STEP = 0.15


def luhn(digits: str) -> bool:
    """Whether the last digit of ``digits`` is its Luhn check digit."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has the check digits of ISO 7064 mod 97-10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    end = 0
    for m in _AT_DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def _ibans(text: str):
    """The longest proposals that end at a word border and that mod-97 confirms; without one, the next word is tried."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        for end in [m.end(), *(m.start() + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")]:
            iban = text[m.start() : end].replace(" ", "")
            if len(iban) >= 15 and mod97(iban):
                yield m.start(), end
                at = end
                break


def mixed(text: str) -> bool:
    """Whether digits and letters change often in ``text``, as they do in drawn strings and not in names with a number."""
    kinds = [c.isdigit() for c in text if c.isalnum()]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return changes >= 4 and len(set(text.lower())) >= 8


def _secrets(text: str):
    """Strings of a known format or with both digits and letters."""
    for m in _SECRET.finditer(text):
        if _KNOWN_SECRET.fullmatch(m[0]) or (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
            yield m.span()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    found += [("iban", a, b) for a, b in _ibans(text)]
    found += [("secret", a, b) for a, b in _secrets(text)]
    scored = [(k, a, b, span_score(text, k, a, b)) for k, a, b in found]
    scored = [s for s in scored if s[0] in BASE or s[3] >= LEAST_ADDED]
    scored.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return scored


def confirmed(kind: str, value: str) -> float:
    """How far the validator of its kind confirms a proposal; base spans and ibans are only proposed if it does."""
    if kind != "secret":
        return CONFIRMED[kind]
    return CONFIRMED[kind] if _KNOWN_SECRET.fullmatch(value) else CONFIRMED[kind] / 3 if mixed(value) else 0.0


def span_score(text: str, kind: str, start: int, end: int) -> float:
    """Prior, validator and context words together, from 0 to 1."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    score = PRIOR[kind] + confirmed(kind, text[start:end]) + CONTEXT_STEP * (bool(CONTEXT[kind].search(near)) - bool(COUNTER_CONTEXT.search(near)))
    return round(min(1.0, max(0.0, score)), 4)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row: ``id_col`` and ``found``, an array of (kind, start, end, score).

    A null or empty text has no spans. Repeated and null ids are kept row by row; further columns are
    left out; an empty table gives an empty result. Spans of different kinds may overlap.
    """

    def fn(texts: list) -> dict:
        return {"found": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in texts]}

    return map_texts(df, [id_col], text_col, fn, "found array<struct<kind:string,start:int,end:int,score:double>>")


def mask_texts(df: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in angle brackets; other columns stay.

    Spans below ``least_score`` stay as they are. Overlapping spans are replaced together under the kind that starts
    first. Null texts stay null. Texts are masked in slices of bounded size, so a worker never holds all texts of a batch twice.
    """

    def masked(text: str | None) -> str | None:
        out, at = [], 0
        for kind, a, b, score in find_spans(text):
            if score < least_score:
                continue
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return text if text is None or not out else "".join(out) + text[at:]

    def fn(texts: list) -> dict:
        return {"masked": [masked(t) for t in texts]}

    at = [c.lower() for c in df.columns].index(text_col.lower())
    own = [f"c{i}" for i in range(len(df.columns))]  # columns of any name are kept, by place
    got = map_texts(df.toDF(*own), [c for c in own if c != own[at]], own[at], fn, "masked string")
    return got.select(*own[:at], "masked", *own[at + 1 :]).toDF(*df.columns)


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, the list of all spans, and their scores in the same order."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col(id_col), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"), F.transform("found", lambda s: s["score"]).alias("scores"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row of ``documents``, digested; see :func:`find_pii` for nulls, repeats and empty tables."""
    return digest_spans(find_pii(read_table(spark, sf_dir, "documents")))

"""Top-k search, Merkle manifest and repair of conversations against plain versions of the same."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tapeloom.llm import bitslices, merkle, turns


def odd_vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[20][1]) for i in range(30)]  # ties at the border
    rows += [(300, None), (301, [0.1, None, 0.3]), (302, [math.nan] * 8), (303, [math.inf] * 8), (320, []), (340, [0.5, 0.5]), (341, [100.0] * 8), (None, [0.1] * 8), (360, [0.0] * 8), (20, rows[20][1]), (342, [-1.0] * 9)]
    return rows


def best_by_brute_force(rows, k=20):
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(held):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(held) if n != at)  # noqa: B905
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "batch"), [(40, 5), (32_768, 256)])
def test_top_k_is_exact(spark, block_rows, batch):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitslices.top_k(df, "vec_id % 20 = 0", block_rows=block_rows, batch=batch)
    assert sorted(map(tuple, got.collect())) == best_by_brute_force(rows)


def test_slices_add_up():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values = rng.integers(-300, 300, (7, 130))
        base, _ = bitslices.slices_of(values[0])
        columns: list[list] = []
        for v in values:
            for b, m in enumerate(bitslices.slices_of(v)[1]):
                while len(columns) <= b:
                    columns.append([])
                columns[b].append(m)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, s in enumerate(bitslices.add_up(columns, 3)))
        assert (total == sum(v - v.min() for v in values)).all() and base == values[0].min()


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        b = i // 3 * 3
        out.append((level[b:i], level[i + 1 : b + 3]))
        i //= 3
    return out


def _leaf(row):
    return _hash(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def manifest_by_brute_force(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in sources}
    trees = {s: _tree([_leaf(r) for r in g]) for s, g in groups.items()}
    top = _tree([trees[s][-1][0] for s in sources])
    for at, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            path = _siblings(trees[s], i) + _siblings(top, at)
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            held = _leaf((*r[:4], r[4].replace("\n", "") if odd and r[4] is not None else r[4]))
            for before, after in path:
                held = _hash(*before, held, *after)
            yield r[0], _leaf(r), trees[s][-1][0], top[-1][0], _hash(*[d for b, a in path for d in b + a]), held, held == top[-1][0]


@pytest.mark.parametrize(("levels", "part_rows"), [(1, 7), (2, 1000), (6, 100_000)])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, levels, part_rows):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rng = random.Random(levels)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "é", "\U0001f600", "zz"]), "en", i, f"text {i}\nend") for i in range(300)]
    rows += [(i, f"lone {i}", None, None, None) for i in range(300, 330)] + [(5, "hot", "en", 5, "text 5\nend")] * 40 + [(None, None, None, None, None), (None, None, None, 3, ""), (7, "hot", "en", 7, "other"), (0, "", "", 0, "")]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, __group string, leaf int").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(manifest_by_brute_force(rows), key=repr)


def test_manifest_of_one_row(spark, tmp_path):
    spark.createDataFrame([(2, "s", "en", 1, "a\n")], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert row.leaf == row.subroot == row.root == _leaf((2, "s", "en", 1, "a\n")) and row.proof_sha256 == _hash() and row.verified == (zlib.crc32(b"2") % 2 == 1)


def cheapest_by_search(roles, faults):
    """Every sequence of edits, by recursion; the least (cost, edits)."""

    @cache
    def rest(t, state, inserts):
        new = "a" if state == "u" else "u"
        found = [(0, "")] if t == len(roles) and state in "-a" else []
        onward = lambda cost, edit, to: (lambda r: found.append((cost + r[0], edit + r[1])))(rest(*to))
        if inserts < 4:
            onward(3, "I", (t, new, inserts + 1))
        if t < len(roles):
            onward(4, "D", (t + 1, state, 0))
            if faults[t] not in ("blank", "duplicate"):
                more = 3 if faults[t] == "truncated" else 0
                if (state + roles[t]) in ("-s", "-u", "su", "au", "ua"):
                    onward(more, "K", (t + 1, roles[t], 0))
                onward(more + 3, "R", (t + 1, new, 0))
        return min(found, default=(10**9, ""))

    return rest(0, "-", 0)


def repaired_by_brute_force(rows):
    convs: dict = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        role, text = "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        held += [((turn is not None, turn or 0), tie, k, turn, role, text) for k in range({0: 0, 3: 2}.get(hit, 1))]
    for conv, held in convs.items():
        held.sort(key=lambda r: r[:3])
        before, faults = set(), []
        for *_, role, text in held:
            end = text.rstrip(turns.SPACES)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in before else "" if end in ".!?" else "truncated")
            before.add((role, text))
        at = [r[3] for r in held if r[3] is not None]
        initials = [r[4][:1] for r in held]
        cost, edits = cheapest_by_search(tuple(initials), tuple(faults))
        left, out = iter(held), []
        for e in edits:
            new = "assistant" if out and out[-1].startswith("u") else "user"
            *_, role, text = (new, "") if e == "I" else next(left)
            if e != "D":
                out.append(f"{new if e == 'R' else role}:{text}")
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        yield conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, _hash("\n".join(out))


def odd_conversations():
    rng = random.Random(8)
    said = ["Fine.", "Oh", "", " \t\n", "Why?  ", "Stop!\x0b", "é.", "a\nb.", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "é"] if c % 3 == 0 else ["user", "assistant"]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(60, None, "user", "a."), (60, None, "user", "b."), (60, 9, "user", "c."), (None, None, None, None), (None, 1, "user", "x."), (61, 3, "user", "d."), (61, 3, "user", "d."), (62, 10**9, "s", "y" * 200_000 + "."), (62, 5, "user", "z.")]
    return [*rows, *[(63, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(90)]]


def test_cheapest_edits_are_the_least_of_all():
    rng = random.Random(3)
    roles = [[rng.choice("suaxsua") for _ in range(rng.randint(0, 11))] for _ in range(600)]
    faults = [[rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in r] for r in roles]
    codes = {"": turns.SOUND, "blank": turns.BLANK, "duplicate": turns.DUPLICATE, "truncated": turns.CUT}
    cost, edits = turns.cheapest([np.array([ord(x) for x in r], np.uint8) for r in roles], [np.array([codes[f] for f in fs], np.uint8) for fs in faults])
    assert [(int(c), e.decode()) for c, e in zip(cost, edits, strict=True)] == [cheapest_by_search(tuple(r), tuple(f)) for r, f in zip(roles, faults, strict=True)]
    assert turns.cheapest([], [])[1] == []


def test_repaired_rows_have_the_digest(spark):
    rows = turns.sorted_rows(spark.createDataFrame([(c, t, r, x) for c, t, r, x in odd_conversations() if r], "conv_id long, turn long, role string, text string"))
    found = turns.repairs(rows)
    by: dict = {}
    for r in sorted(turns.repaired_turns(rows, found).collect(), key=lambda r: r.place):
        by.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    want = {r.conv: r.repaired_sha256 for r in turns.repaired_digests(rows, found).collect()}
    assert {c: _hash("\n".join(by.get(c, []))) for c in want} == want
    for said in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))

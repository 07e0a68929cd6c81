"""Vector codes, conversation repair and substring deduplication against brute force and edge rows."""

import hashlib
import re
from itertools import product
from random import Random

import numpy as np
import pytest

from clipweave.llm import conversation_repair as repair
from clipweave.llm import queries, substrings, vector_codes


# ---------------------------------------------------------------- vector codes


@pytest.mark.parametrize("scale", [3, 200, 1 << 24])
def test_nearest_by_pivots_is_the_nearest(scale):
    rng = np.random.default_rng(scale)
    parts, entries = rng.integers(-scale, scale, (400, 4)), rng.integers(-scale, scale, (64, 4))
    entries[7] = entries[3]  # ties go to the lower number
    pivots = vector_codes.spread_pivots(entries[None], 4)[0]
    known = vector_codes.pivot_distances(parts, pivots).astype("<f4").astype(float)
    at, best, made = vector_codes.nearest(parts, known, entries, pivots)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (best == every.min(1)).all()
    assert made < every.size / (1 if scale == 3 else 4)


def plain_codes(rows, parts, size, rounds):
    kept = [(k, v, lab) for k, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    wide = len(kept[0][1]) // parts
    whole = [[int(np.floor(256 * x)) for x in v] for _, v, _ in kept]
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:size]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    total = {lab: sum(e for e, r in zip(errors, kept) if r[2] == lab) for lab in {r[2] for r in kept}}
    return sorted(((k, "".join(f"{n:02x}" for _, n in f), e, total[lab]) for (k, _, lab), f, e in zip(kept, found, errors)), key=repr), ",".join(str(x) for b in books for e in b for x in e)


def test_codes_equal_the_plain_rule(spark):
    rng = Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, None])) for k in range(60)]
    rows += [(3, rows[9][1], 1), (None, rows[4][1], 2), (70, rows[5][1], 2), (70, rows[5][1], 2), (71, None, 1), (72, [], 1), (73, [1.0] * 7, 1), (74, [1.0] * 7 + [None], 1), (75, [float("nan")] * 8, 1), (76, [float("inf")] + [0.0] * 7, 2)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    exact = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for k, v, lab in rows]
    codes, books = vector_codes.compress(table, parts=4, entries=6, rounds=2, pivots=2)
    want, text = plain_codes(exact, 4, 6, 2)
    assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in codes.collect()), key=repr) == want
    assert vector_codes.codebook_text(books) == text


def test_codes_of_odd_tables(spark):
    shape = "vec_id long, embedding array<double>, label string"
    empty, books = vector_codes.compress(spark.createDataFrame([(1, None, "a"), (2, [float("nan")] * 16, "b")], shape))
    assert empty.collect() == [] and empty.columns == ["vec_id", "label", "code", "error", "label_error"] and vector_codes.codebook_text(books) == ""
    few, books = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 16, None), (2, [1e300] * 16, None), (3, [-1e300] * 16, None)], shape))
    got = {r.vec_id: r for r in few.collect()}
    assert books.entries.shape == (16, 3, 1) and [got[k].code for k in (1, 2, 3)] == ["00" * 16, "01" * 16, "02" * 16]
    assert all(r.error == 0 == r.label_error for r in got.values())


# ---------------------------------------------------------------- conversation repair


def edits(turns):
    """Every sequence of edits of turns (role, fault) with at most two insertions in a row: cost, audit, initials."""
    inserts = [p for n in range(3) for p in product("ua", repeat=n)]
    for before in product(inserts, repeat=len(turns) + 1):
        base = 3 * sum(map(len, before))
        choices = []
        for role, fault in turns:
            own = [(4, "D", "")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                own += [(more, "K", role[:1] or "?"), (3 + more, "R", "u"), (3 + more, "R", "a")]
            choices.append(own)
        for taken in product(*choices):
            initials = "".join("".join(b) + t[2] for b, t in zip(before, taken)) + "".join(before[-1])
            yield base + sum(t[0] for t in taken), "".join("I" * len(b) + t[1] for b, t in zip(before, taken)) + "I" * len(before[-1]), initials


def test_cheapest_edits_are_the_cheapest_of_all():
    rng = Random(3)
    for _ in range(40):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(0, 4))]
        want = min((c, a) for c, a, initials in edits(turns) if re.fullmatch("(s?(ua)+)?", initials))
        kinds = "".join(repair._kind(r, f) for r, f in turns)
        assert min((c + repair.closing(e)[0], a + repair.closing(e)[1]) for e, c, a in repair.moves(kinds, 0)) == want


def test_few_stacks_and_their_meaning():
    assert len(repair.STACKS) == 8 and repair.AUTOMATON.accepts(repair.STACKS[0])
    for word in map("".join, (p for n in range(7) for p in product("sua", repeat=n))):
        tops = [repair.STACKS[0]]
        for symbol in word:
            tops = [n for t in tops for n in repair.AUTOMATON.shifted(t, symbol)]
        assert any(map(repair.AUTOMATON.accepts, tops)) == bool(re.fullmatch("(s?(ua)+)?", word))


def plain_summary(rows):
    """One conversation's (turn, role, text), in order."""
    roles, texts = [r for _, r, _ in rows], [t for _, _, t in rows]
    found = repair.faults(roles, texts)
    kinds = "".join(map(repair._kind, roles, found))
    cost, audit = min((c + repair.closing(e)[0], a + repair.closing(e)[1]) for e, c, a in repair._parsed(kinds, 0))
    lines = "\n".join(map(":".join, zip(*repair.repaired(roles, texts, audit, 0))))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_long_conversations_in_blocks(spark, block_rows):
    rng = Random(block_rows)
    rows = []
    for conv, n in ((1, 400), (2, 1), (3, 60), (None, 25), (5, 9), (6, 30)):
        for k in range(n):
            turn = rng.choice([None, k, k, k + 1, 2 * k])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["a. ", "b", "c!", "", " \n", None, f"no {k}.", f"long {k} " * 9])))
    rng.shuffle(rows)
    got = repair.summarize(repair.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, n int").repartition(3), block_rows))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = {c: plain_summary(sorted(((t, r or " " if r is None else r, " " if x is None else x) for d, t, r, x in rows if d == c), key=key)) for c in {r[0] for r in rows}}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[c] for c in columns) for r in got.collect()} == want


def test_repair_of_empty_and_good_tables(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert repair.summarize(repair.repair(spark.createDataFrame([], shape))).count() == 0
    rows = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A.")], shape)
    blocks = repair.repair(rows).collect()
    assert [(b.cost, b.audit, b.roles, b.texts) for b in blocks] == [(0, "KKK", ["system", "user", "assistant"], ["S.", "Q?", "A."])]


# ---------------------------------------------------------------- substring deduplication


def plain_removal(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for k in range(len(w) - window + 1) if d is not None and first[tuple(w[k : k + window])] < d for j in range(k, k + window)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd_docs():
    rng = Random(8)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4)
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 26, 60]))] for _ in range(6)]
    rows = []
    for k in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(0, 5))]
        text = rng.choice([" ", "\n", "\t \x0b"]).join(w for p in parts for w in p)
        rows.append((k if rng.random() < 0.9 else 5, text))
    rows += [(1, None), (2, ""), (3, " \n\t"), (None, " ".join(passages[3])), (None, None), (-4, " ".join(passages[4])), (200, " ".join(passages[4] + passages[4])), (201, "x y   " * 40), (202, "x y   " * 40), (203, " ".join("ab" * 20))]
    rows += [(300, " ".join(["same"] * 500)), (301, " ".join(["same"] * 20000)), (302, " ".join(passages[5]) + " " + "z" * 200000 + " end"), (302, "other words")]
    return rows


def test_removed_words_are_those_of_earlier_windows(spark, odd_docs):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in odd_docs], "doc_id long, text string, n_words int, kept string").repartition(7)
    got = substrings.dedup_substrings(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == plain_removal(odd_docs)


def test_factors_are_passages_of_earlier_documents(spark, odd_docs):
    texts = {d: t.split() for d, t in odd_docs if t and d is not None and sum(x == d for x, _ in odd_docs) == 1}
    seen = 0
    for r in substrings.dedup_substrings(spark.createDataFrame(odd_docs, "doc_id long, text string")).collect():
        for f in r.factors if r.doc_id in texts else ():
            assert f.ref_doc < r.doc_id and f.length >= substrings.WINDOW
            if f.ref_doc in texts:
                assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.ref_doc][f.ref_start : f.ref_start + f.length]
                seen += 1
    assert seen > 20
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_do_not_depend_on_stretches(monkeypatch):
    data = " ".join(f"w{k % 37}" for k in range(3000)).encode() + b"\n" + b"y" * 500 + b" end"
    want = substrings.word_hashes(data)
    monkeypatch.setattr(substrings, "STRETCH", 50)
    assert len(want) == 3002 and (substrings.word_hashes(data) == want).all()
    assert substrings._kept(data, np.arange(3002) % 2 == 1).split() == data.split()[::2]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_conversation_repair", "op13_dedup_substrings"])
def test_new_queries_equal_their_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.SQL[name])
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows == sorted(want.fetchall(), key=repr)

import random

import numpy as np
import pytest

from quernel.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    marks = [np.zeros(len(t) + 1, int) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i] += 1
                marks[d][i + length] -= 1
    out = []
    for t, m in zip(texts, marks):
        gone = np.cumsum(m)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sum(b & 0xC0 != 0x80 for b in kept), kept))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    base = word(3000)
    out = [None, "", "a" * 399, "a" * 400, "a" * 401, "b" * 2000, "ab" * 700, "z" * 500 + base[:500] + "z" * 500, base[:500], base[100:520]]
    for k in range(50):
        a, n = rng.randint(0, 2200), rng.choice([200, 399, 400, 401, 450, 600, 900])
        out.append(word(rng.randint(0, 300)) + base[a : a + n] + word(rng.randint(0, 200)))
    return out + [out[-1], out[-2], out[-2].upper()]


@pytest.mark.parametrize("seed, hot", [(1, 10**6), (2, 1), (3, 4)])
def test_equals_brute_force(make_docs, seed, hot):
    rows = texts(seed)
    got = {r["row_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["n_kept_chars"], bytes(r["kept"])) for r in S.remove_repeats(make_docs([(i, t, "en", None) for i, t in enumerate(rows)]), hot_contexts=hot).collect()}
    assert [got[i] for i in range(len(rows))] == brute([(t or "").encode() for t in rows], 400)


def test_repeated_rows_and_null_ids(make_docs):
    long = "".join(chr(97 + i * i % 26) for i in range(600))
    got = sorted((str(r["row_id"]), r["n_removed"]) for r in S.remove_repeats(make_docs([(1, long, "en", "s"), (1, long, "en", "s"), (None, "short", None, None)])).collect())
    assert got == [("1", 600), ("1", 600), ("None", 0)]


@pytest.mark.parametrize("most", [13, 14])
def test_filters_that_cannot_hold_the_keys_change_nothing(make_docs, monkeypatch, most):
    """Beyond its bits a filter lets everything pass, and the exact joins decide."""
    monkeypatch.setattr(S.blooms, "MOST_BITS", most)
    monkeypatch.setattr(S.blooms, "LEAST_BITS", 12)
    rows = texts(5)
    got = {r["row_id"]: (r["n_removed"], bytes(r["kept"])) for r in S.remove_repeats(make_docs([(i, t, "en", None) for i, t in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == [(w[1], w[4]) for w in brute([(t or "").encode() for t in rows], 400)]


def test_very_long_text(make_docs):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = ["".join(rng.choice("abcdefgh ") for _ in range(1_500_000)) + shared + "x", "y" + shared]
    got = {r["row_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.remove_repeats(make_docs([(i, t, "en", None) for i, t in enumerate(rows)])).collect()}
    assert got == {0: (1_501_001, 1000, 1), 1: (1001, 1000, 1)}


def test_empty_table(make_docs):
    assert S.remove_repeats(make_docs([])).count() == 0


def test_triggers_depend_on_their_surroundings_alone():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(97, 110, n).astype(np.uint8) for n in (500, 700))
    shared = rng.integers(97, 110, 900).astype(np.uint8)
    inside = lambda head: {t - len(head) for t in S.triggers(np.concatenate([head, shared])).tolist() if S.RADIUS <= t - len(head) < 900 - S.RADIUS - S.WINDOW}
    assert inside(a) == inside(b) != set()


def test_chunks_keep_keys_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "CHUNK_CONTEXTS", 3)
    rng = random.Random(4)
    shared = bytes(rng.randrange(97, 120) for _ in range(700))
    rows = [(k, i, -i, 240, 100, 180, 1, bytes(rng.randrange(97, 120) for _ in range(60)) + shared[:420]) for k in range(3) for i in range(5)]
    names = ["key", "rid", "rid2", "trigger", "lo", "hi", "copies", "context"]
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    whole = [tuple(r.values()) for b in S._compare(400)([table]) for r in b.to_pylist()]
    parts = [tuple(r.values()) for b in S._compare(400)([table.slice(i, 2) for i in range(0, 15, 2)]) for r in b.to_pylist()]
    assert sorted(whole) == sorted(parts) and whole


def test_batches_of_texts_are_small(spark, monkeypatch):
    """Executors hold a few batches outside the heap, whatever the length of texts."""
    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    monkeypatch.setattr(S, "_maybe", lambda bloom: lambda batches: (b.append_column("hit", pa.array([b.nbytes < 5_000_000] * b.num_rows)) for b in batches))
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('x', id, ' '), 20000) AS text").coalesce(1)
    kept = S.remove_repeats(docs.filter("doc_id < 0").unionByName(docs).coalesce(1), length=10**6)
    assert kept.filter("n_removed = 0").count() == 300
    got = docs.mapInArrow(sizes, "n long").collect()
    assert len(got) > 1 and max(r["n"] for r in got) < 5_000_000

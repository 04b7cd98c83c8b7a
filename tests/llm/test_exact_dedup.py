import hashlib
import random
from collections import Counter

import pytest

from quernel.llm import exact_dedup as E


def brute(rows):
    norm = lambda t: (t or "").translate(str.maketrans(E.UPPER, E.LOWER))
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return Counter((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("share", [1024, 8, 2])
def test_labels_equal_brute_force(make_docs, share):
    rng = random.Random(share)
    rows = [(i, rng.choice(["Hot TEXT", "hot text", "ÄB", "äB", "", None, f"t{i % 40}", "x" * 50_000])) for i in range(400)] + [(5, "Hot TEXT"), (5, "Hot TEXT"), (None, "Hot TEXT"), (None, None)]
    got = E.label_duplicates(make_docs([(i, t, "en", "s") for i, t in rows]), share=share).collect()
    assert Counter((r["row_id"], r["keep_id"], r["group_size"], r["digest"]) for r in got) == brute(rows)
    kept = Counter(r["digest"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["digest"] for r in got})
    assert all(r["row_id"] == r["keep_id"] for r in got if r["kept"])


def test_dropping_keeps_one_whole_row(make_docs):
    docs = make_docs([(1, "A", "en", "s"), (2, "a", "de", None), (2, "a", "de", None), (None, "b", None, "s"), (3, None, None, None)])
    out = E.drop_duplicates(docs, share=2)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "b"), (2, "a"), (3, "")]


def test_empty_table(make_docs):
    assert E.label_duplicates(make_docs([])).count() == 0 and E.drop_duplicates(make_docs([])).count() == 0


def test_misra_gries_bound():
    import pyarrow as pa

    rng = random.Random(1)
    values = [f"h{rng.randint(0, 3)}" if rng.random() < 0.6 else f"c{i}" for i in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 100])], ["digest"]) for i in range(0, 5000, 100)]
    found = dict(zip(*(c.to_pylist() for c in next(E.misra_gries(batches, 20)).columns)))
    for value, count in Counter(values).items():
        assert found.get(value, 0) <= count
        assert found.get(value, 0) >= count - 5000 / 21


def test_dropping_equals_brute_force(make_docs):
    """Repeated and null ids, hot groups, rows that differ in other columns only."""
    rng = random.Random(9)
    rows = [(rng.choice([None, i % 90]), rng.choice(["Hot TEXT", "hot text", None, "", f"t{i % 30}", f"u{i}"]), rng.choice(["en", None]), "s") for i in range(300)]
    norm = lambda t: (t or "").translate(str.maketrans(E.UPPER, E.LOWER))
    best = {}
    for i, t, _, _ in rows:
        best[norm(t)] = max(best.get(norm(t), -1), -1 if i is None else i)
    for share in (1024, 4):
        out = E.drop_duplicates(make_docs(rows), share=share).collect()
        assert sorted((norm(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in out) == sorted(best.items())
        assert all((r["doc_id"], r["text"], r["lang"], r["source"]) in rows for r in out)

import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from quernel.llm import packing
from quernel.llm.bpe import tokenizer_path


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def check(found, texts, capacity, end_id=2):
    """Pieces and places against the tokenizers library: every id is there once, and sequences have no gaps."""
    words, expected, total = library(), [], 0
    for doc_id, text in texts:
        ids = words.encode(text or "", add_special_tokens=False).ids + [end_id]
        total += len(ids)
        cuts = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for piece, (a, b) in enumerate(zip([0, *cuts], cuts)):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
    key = lambda row: (row[0] is None, *[v or 0 for v in row])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(expected, key=key)
    fill = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert not fill or max(fill.values()) <= capacity
    return len(fill), -(-total // capacity)


def test_whole_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(packing.op12_packing(spark, sf).collect(), texts, 1024)
    assert used <= least * 1.02 + 1


def test_edge_rows(spark, make_docs):
    texts = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id"), (4, "word " * 500), (5, "x" * 5000), (6, "<|endoftext|> it's  <|endoftext|>"), (7, "one  two   three\n \n four\t \t"), (8, " ")]
    docs = make_docs([(i, t, "en", "s") for i, t in texts]).repartition(3)
    found = packing.pack(docs, capacity=64)
    used, least = check(found.collect(), texts, 64)
    assert used <= least + 1
    whole = packing.sequences(found).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in found.collect()) and max(len(r.ids) for r in whole) <= 64
    ids = {r.sequence_id: r.ids for r in whole}
    assert all(ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in found.collect())


def test_empty(spark, make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_one_length_and_many_tasks(spark, make_docs):
    texts = [(i, "a b c") for i in range(500)]
    used, least = check(packing.pack(make_docs([(i, t, None, None) for i, t in texts]).repartition(7), capacity=10).collect(), texts, 10)
    assert used == 250 and least == 200  # two of four ids each


def test_ids_equal_the_library():
    ids, words = packing.Ids(tokenizer_path()), library()
    rng = np.random.default_rng(3)
    parts = [" ", " ", "\n", "\t", "a", "bc", "'", "s", "1", ".", "é", " ", "\u0085", "\x1c", "中", "<|endoftext|>", "𝒳"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert list(np.frombuffer(ids.encode(text), np.uint32)) == words.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("low,high,slack", [(1, 1025, 1.005), (300, 700, 1.01), (520, 1025, None), (1, 60, 1.001)])
def test_plans(low, high, slack):
    lengths = np.random.default_rng(7).integers(low, high, 20_000)
    counts = Counter(lengths.tolist())
    plan = packing.best_plan(counts, 1024)
    fill, pieces = {}, Counter()
    for length, first, sequence, offset in plan.ranges:
        times = min([f for n, f, *_ in plan.ranges if n == length and f > first], default=counts[length]) - first
        pieces[length] += times
        for s in range(sequence, sequence + times):
            fill.setdefault(s, []).append((offset, length))
    assert pieces == counts and len(fill) == plan.sequences
    for members in fill.values():
        members.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(members, members[1:])) and members[0][0] == 0 and sum(members[-1]) <= 1024
    assert plan.sequences <= (-(-int(lengths.sum()) // 1024) * slack + 1 if slack else len(lengths))
    assert len(plan.ranges) < 20 * 1024


def test_exact_complements_fill_whole_sequences():
    plan = packing.Plan({1000: 5, 24: 2, 14: 6, 10: 3, 8: 9}, 1024)  # 1000 + 24, 1000 + 14 + 10, 1000 + 8 + 8 + 8
    assert plan.sequences == 6 and packing.best_plan({1000: 4, 24: 2, 14: 1, 10: 1, 8: 3}, 1024).sequences == 4


def test_capacity_is_checked(spark, make_docs):
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), capacity=0)


def test_table_of_words_holds_those_of_large_texts():
    made = []
    table = packing.Recent(lambda key: made.append(key) or key.encode())
    for _ in range(2):
        for i in range(400_000):
            table[str(i)]
    assert len(made) == 400_000


def test_short_cuts_give_the_ids_of_the_library():
    words = packing.Ids(packing.tokenizer_path())
    for text in ("a b", "Word Wörter, слово. x1 ...", "a  b", "a \n b", "a\x1c b", "a　 b", " ก ͸a b", "\U0001f600 x", "it's <|endoftext|> a"):
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), np.uint32).tolist() == want, text

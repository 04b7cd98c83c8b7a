import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quernel.llm import sharding as S


@pytest.mark.parametrize("rows_per_task", [1_000_000, 7])
def test_exact_sizes_and_gapless_slots(make_docs, rows_per_task):
    rows = [(i % 150, None if i % 9 == 0 else "" if i % 9 == 1 else "é" * (i % 7), "en", "s") for i in range(200)] + [(None, "x", None, None)] * 3
    got = S.shuffle_into_shards(make_docs(rows), rows_per_task=rows_per_task).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["row_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_reruns_agree(spark, sf):
    a, b = (sorted(map(tuple, S.op8_sharding(spark, sf).collect()), key=repr) for _ in range(2))
    assert a == b


def test_few_and_no_rows(make_docs):
    assert sorted((r["shard"], r["slot"]) for r in S.shuffle_into_shards(make_docs([(1, "a", "en", "s"), (2, "b", "en", "s")])).collect()) == [(0, 0), (1, 0)]
    assert S.shuffle_into_shards(make_docs([])).count() == 0


def test_matrix_law():
    """Sums are exact, and a cell's mean is that of the hypergeometric law."""
    draws = np.array([S.draw_matrix([30, 50, 20], [40, 60], seed)[0, 0] for seed in range(400)])
    matrix = S.draw_matrix([30, 50, 20], [40, 60], 1)
    assert matrix.sum(axis=1).tolist() == [30, 50, 20] and matrix.sum(axis=0).tolist() == [40, 60]
    assert abs(draws.mean() - 12) < 0.5 and 0 < draws.std() < 4


def test_matrix_beyond_a_billion_rows():
    blocks, ranges = [5 * 10**8 + i for i in range(9)] + [0, 499_999_964], S.even_parts(5 * 10**9, 24)
    matrix = S.draw_matrix(blocks, ranges, 3)
    assert matrix.min() >= 0 and matrix.sum(axis=1).tolist() == blocks and matrix.sum(axis=0).tolist() == ranges
    wanted = np.outer(blocks, ranges) / sum(ranges)
    assert np.abs(matrix - wanted).max() < 8 * np.sqrt(wanted.max())
    assert S.draw_matrix([2 * 10**9], [10**9, 10**9], 1).tolist() == [[10**9, 10**9]]


def test_own_draws_have_the_law_of_numpys(monkeypatch):
    monkeypatch.setattr(S, "NUMPY_MOST", 1)
    rng = np.random.default_rng(2)
    for good, bad, draws in [(30, 50, 20), (5, 1000, 500), (1000, 3, 900), (7, 7, 14), (4, 9, 0)]:
        got = np.array([S.draw_split(good, bad, draws, rng) for _ in range(4000)])
        want = rng.hypergeometric(good, bad, draws, 4000)
        assert max(0, draws - bad) <= got.min() and got.max() <= min(good, draws)
        assert abs(got.mean() - want.mean()) <= 5 * want.std() / 4000**0.5 + 1e-9 and abs(got.std() - want.std()) < 0.1 * want.std() + 1e-9
    big = np.array([S.draw_split(3 * 10**9, 10**9, 10**6, rng) for _ in range(300)])
    assert abs(big.mean() - 750_000) < 5 * 433 / 300**0.5 and 350 < big.std() < 520


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of longs and 32-bit ints (as numpy int32); a null leaves the hash as it is."""
    for v in values:
        if v is not None:
            raw = v.tobytes() if isinstance(v, np.int32) else int(v).to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))
    return seed - 2**64 if seed >= 2**63 else seed


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_shards_and_slots_equal_brute_force(make_docs, rows_per_task):
    """Deal rows into blocks, permute, exchange by the matrix and permute again, in plain Python."""
    seed = 7
    rows = [(i, None if i % 9 == 0 else "é" * (i % 7), "en", "s") for i in range(150)] + [(None, "x", None, None), (3, "b", "en", "s"), (3, "c", "en", "s")]
    plain = []
    for i, t, _, _ in rows:
        raw = (t or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 8
        plain.append((i, crc, size, spark_hash(np.int32(seed), i, crc, size)))
    n = len(plain)
    blocks = min(2016, max(64, -(-n // rows_per_task)))
    per_shard = min(84, max(1, -(-n // (24 * rows_per_task))))
    ranges = [part for size in S.even_parts(n, 24) for part in S.even_parts(size, per_shard)]
    dealt = {}
    for r in plain:
        dealt.setdefault(spark_hash(np.int32(seed + 1), r[3]) % blocks, []).append(r)
    matrix = S.draw_matrix([len(dealt.get(b, ())) for b in range(blocks)], ranges, seed)
    order = lambda salt: lambda r: (spark_hash(np.int32(seed + salt), r[3]), r[0] is not None, r[0] or 0, r[1])
    received = [[] for _ in ranges]
    for b, members in dealt.items():
        members = sorted(members, key=order(2))
        for c, count in enumerate(matrix[b].tolist()):
            received[c] += members[:count]
            members = members[count:]
    want = []
    for c, members in enumerate(received):
        before = sum(len(received[x]) for x in range(c // per_shard * per_shard, c))
        want += [(r[0], r[2], r[1], c // per_shard, before + k) for k, r in enumerate(sorted(members, key=order(3)))]
    got = [tuple(r) for r in S.shuffle_into_shards(make_docs(rows), rows_per_task=rows_per_task).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_very_long_text(make_docs):
    got = S.shuffle_into_shards(make_docs([(1, "é" * 3_000_000, "en", "s")])).first()
    assert (got["size"], got["text_crc32"]) == (6_000_008, zlib.crc32(("é" * 3_000_000).encode()))


def test_orders_are_mixed(spark):
    """Neighbours in the input are spread evenly over shards."""
    docs = spark.range(2400).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = S.shuffle_into_shards(docs).filter("row_id < 1200").groupBy("shard").count().collect()
    assert len(got) == 24 and all(25 <= r["count"] <= 75 for r in got)

import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quernel.llm import bpe, language_id
from quernel.llm import exact_dedup as E
from quernel.session import materialize
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_ngram_join import brute as brute_near
from tests.llm.test_source_mixing import brute_targets


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    rejected = {r["row_id"] for r in language_id.identify(docs, model).filter("rejected").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in rejected}
    winners = {keep for _, keep, _, _ in brute_exact([(i, r["text"]) for i, r in rows.items()])}
    rows = {i: r for i, r in rows.items() if i in winners}
    component = brute_near([(i, r["text"]) for i, r in rows.items()], 5, 80)
    rows = {i: r for i, r in rows.items() if component[i][1] == i}
    sizes = {}
    order = {}
    for i, r in rows.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
        order.setdefault(r["source"], []).append((hashlib.md5(str(i).encode()).hexdigest(), i))
    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    ids_of = lambda t: hashlib.sha256(np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()
    want = []
    for source, target in brute_targets(sizes).items():
        left = int(np.floor(target + 0.5))
        while left > 0:
            for _, i in sorted(order[source]):
                words = rows[i]["text"].split()
                if left <= 0:
                    break
                text = rows[i]["text"] if left >= len(words) else " ".join(words[:left])
                want.append((i, ids_of(text)))
                left -= len(words)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got) == sorted(want)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0


EDGE = [
    (5, None, "en", "src1"), (6, "", "en", "src1"), (7, " \t", None, None), (None, None, None, None), (8, "1234 !?", "en", "src2"),
]


def edge_documents(spark, sf):
    """The driver's documents with nulls, empty and very long texts, repeated rows, repeated and null ids, and columns whose
    names clash with those used inside."""
    plain = [tuple(r)[:4] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    english = [r for r in plain if r[2] == "en" and r[1] and len(r[1].split()) > 60]
    one, two, three, four = english[:4]
    odd = [one, one, (one[0], two[1] + " changed end", "en", None), (two[0], three[1].upper(), None, "src3"), (None, four[1], "en", "src1"), (None, four[1] + " more", "en", None)]
    odd += [(three[0], " ".join([four[1]] * 200), "en", "src9"), (10**12, one[1].replace(" ", "  "), "en", "src1")]
    rows = [(*r, None if r[1] is None else len(r[1]), "digest", 1, 2, 3, "root") for r in plain + EDGE + odd]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, cid long, slot long, rank long, root string")


def test_every_stage_on_edge_rows(spark, sf):
    docs = edge_documents(spark, sf)
    columns = docs.columns
    rows_of = lambda df: [tuple(r) for r in df.collect()]
    norm = lambda t: (t or "").translate(str.maketrans(E.UPPER, E.LOWER))
    stages = dict(corpus_pipeline.STAGES)

    kept = materialize(stages["language_id"](spark, docs, sf), "kept")
    have = rows_of(kept)
    assert kept.columns == columns and not [r for r in have if not any(c.isalpha() for c in r[1] or "")]
    assert Counter(map(repr, have)) - Counter(map(repr, rows_of(docs))) == Counter()
    assert len(have) >= docs.count() - len(EDGE) - 3

    exact = materialize(stages["exact_dedup"](spark, kept, sf), "exact")
    best = {}
    for r in have:
        best[norm(r[1])] = max(best.get(norm(r[1]), -1), -1 if r[0] is None else r[0])
    have = rows_of(exact)
    assert exact.columns == columns and sorted((norm(r[1]), -1 if r[0] is None else r[0]) for r in have) == sorted(best.items())

    near = materialize(stages["near_dedup"](spark, exact, sf), "near")
    number = {repr(r): k for k, r in enumerate(sorted(have, key=lambda r: (-1 if r[0] is None else r[0], r[1])))}
    component = brute_near([(number[repr(r)], r[1]) for r in have if r[0] is not None], 5, 80)
    left = rows_of(near)
    assert near.columns == columns and {repr(r) for r in left} <= set(number)
    assert sum(r[0] is None for r in left) == sum(r[0] is None for r in have)
    of = Counter(component[number[repr(r)]][1] for r in left if r[0] is not None)
    assert set(of.values()) == {1} and set(of) == {c for _, c in component.values()}

    mixed = materialize(stages["source_mixing"](spark, near, sf), "mixed")
    sizes, words = {}, {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    for r in rows_of(mixed):
        words[r[3]] = words.get(r[3], 0) + len(r[1].split())
        assert r[4] == len(r[1]) and any(x[0] == r[0] and x[3] == r[3] and x[1].split()[: len(r[1].split())] == r[1].split() for x in left)
    assert mixed.columns == columns
    for source, target in brute_targets(sizes).items():
        assert abs(words.get(source, 0) - target) <= 0.5

    tokenizer = Tokenizer.from_file(bpe.tokenizer_path())
    got = corpus_pipeline.STAGES[-1][1](spark, mixed, sf).collect()
    sha = lambda t: hashlib.sha256(np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == Counter((r[0], sha(r[1])) for r in rows_of(mixed))


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id IS NULL")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.count() == 0

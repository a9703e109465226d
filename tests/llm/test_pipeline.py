import hashlib
import random

import corpus_pipeline
import pytest

from millrace.llm import exact_dedup, sentence_pieces
from tests.llm.test_decontaminate import brute as brute_contaminated
from tests.llm.test_simhash import brute as brute_near


def similar_components(rows):
    """Flooding over links of 2 bits or less, and of a 5-word similarity of 0.8 or more."""
    fps = {i: int(f, 16) for i, (f, _) in brute_near(rows, width=5).items()}
    sets = {}
    for i, t in rows:
        words = t.lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    comp = {}
    for start in sorted(fps):
        todo = [] if start in comp else [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += [y for y in fps if y not in comp and near(x, y)]
    return comp


def changed(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "zz"
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(6)
    out = str(tmp_path_factory.mktemp("corpus"))
    vocab = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(25)) for i in range(5)]
    rows = [(i, text(rng.randint(30, 120))) for i in range(300)]
    rows += [(1000 + i, rows[i][1].upper()) for i in range(40)] + [(1100, rows[3][1]), (1100, rows[3][1])]
    rows += [(2000 + i, rows[50 + i][1] + " " + items[i % 5][1]) for i in range(20)]
    rows += [(2500 + i, changed(rows[100 + i][1], rng, i % 3)) for i in range(40)]
    rows += [(2600 + i, changed(rows[99][1], rng, 1)) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, "?! 12"), (3003, "".join(chr(0x4E00 + i) for i in range(300)))]
    docs = [(i, t, "xx" if i < 3000 else None, "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    columns, seen = docs.columns, texts(docs)
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language_id"](spark, docs, folder)
    gone = {i for i, _ in seen} - {i for i, _ in texts(docs)}
    assert {3000, 3001, 3002, 3003} <= gone and len(gone) < 8
    seen = texts(docs)
    docs = stages["exact_dedup"](spark, docs, folder)
    best = {}
    for i, t in seen:
        best[t.lower()] = max((i, t), best.get(t.lower(), (-1, "")))
    assert texts(docs) == sorted(best.values())
    docs = stages["simhash_near_dedup"](spark, docs, folder)
    near = similar_components(sorted(best.values()))
    seen = [(i, t) for i, t in sorted(best.values()) if near[i] == i]
    assert texts(docs) == seen and len(seen) < len(best) - 20
    docs = stages["decontaminate"](spark, docs, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contaminated(seen, items) if r[-1]}
    seen = [(i, t) for i, t in seen if i not in bad]
    assert bad and texts(docs) == seen and docs.columns == columns
    out = {r.doc_id: r.decoded_sha256 for r in stages["sentencepiece"](spark, docs, folder).collect()}
    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in seen}
    assert corpus_pipeline.run(spark, folder).count() == len(seen)


def test_index_keeps_earlier_batches(spark):
    index = exact_dedup.fresh_index(spark)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, digest int, row string")
    first = batch([(1, "A", 0, ""), (2, "a", 0, ""), (3, None, 0, ""), (3, None, 0, ""), (None, "b", 0, "")])
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.dedup(first, index).collect()) == [(0, 1, True), (2, 2, False), (2, 2, True), (3, 2, False), (3, 2, True)]
    second = batch([(9, "a", 0, ""), (10, "c", 0, ""), (11, "C", 0, "")])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.dedup(second, index).collect()) == [(9, 2, False), (10, 11, False), (11, 11, True)]
    assert index.read().count() == 4
    third = exact_dedup.kept_documents(batch([(5, "", 0, ""), (6, "d", 7, "x"), (6, "d", 7, "x")]), index)
    assert [tuple(r) for r in third.collect()] == [(6, "d", 7, "x")]
    assert exact_dedup.dedup(first.limit(0), index).count() == 0
    index.drop()


def whole(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a benchmark item of few words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_run_on_an_empty_table(spark, tmp_path):
    assert whole(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")) == []


def test_run_with_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    rows = [(k, text()) for k in range(60)]
    rows += [(None, text()), (None, text()), (None, None), (7, rows[7][1]), (7, rows[7][1]), (70, rows[8][1].upper()), (71, "long " + text() * 300)]
    names = "doc_id long, text string, lang string, source string, n_chars long, __tag int, fp string, node string, digest string, kept string"
    docs = spark.createDataFrame([(i, t, "xx", "s", 1, 2, "f", "n", "d", "k") for i, t in rows], names)
    got = whole(spark, tmp_path, docs)
    want = sorted([*range(8), *range(9, 60), 70, 71, -1, -1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == want

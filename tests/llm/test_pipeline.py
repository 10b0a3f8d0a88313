import hashlib
import random

import pytest
from test_duplicates import ascii_lower, brute_fingerprint, union
from test_models import brute_items
from tokenizers import Tokenizer

import corpus_pipeline
from keytide.llm import bpe, common, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(21)
    plain = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(plain) for _ in range(rng.randrange(20, 90))) for _ in range(120)]
    labels = []
    for i in range(0, 60, 3):
        ws = texts[i].split()
        for _ in range(4):
            ws[rng.randrange(len(ws))] = rng.choice(["nasty", "vile", "rotten"])
        texts[i] = " ".join(ws)
    labels = [(i, 1, int(i % 3 == 0)) for i in range(50)]
    texts[61], texts[62] = texts[60].upper(), texts[60]
    near = " ".join(rng.choice(plain) for _ in range(400))
    texts[63], texts[64] = near, near + " tail"
    bench = [(k, " ".join(rng.choice(plain) for _ in range(25)) + ".") for k in range(5)]
    for k, i in enumerate((70, 71)):
        texts[i] = texts[i] + " " + bench[k][1] + " more words"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", "s", 0), (202, None, "en", "s", 0)]
    return rows, labels, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels, bench = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def brute(spark, folder):
    rows, labels, bench = corpus()
    docs = common.table(spark, folder, "documents")
    model = toxicity.train(docs, common.table(spark, folder, "labels"))
    score = lambda t: 1 - model.at_most(model.score([t]))[0, 0]
    kept = [r for r in rows if score(r[1]) < toxicity.REJECT_FROM]
    assert not any("nasty" in (r[1] or "") and "rotten" in r[1] for r in kept) and len(kept) > 90
    best = {}
    for r in kept:
        best[ascii_lower(r[1])] = max(best.get(ascii_lower(r[1]), -1), r[0])
    kept = [r for r in kept if best[ascii_lower(r[1])] == r[0]]
    fps = [brute_fingerprint(r[1]) for r in kept]
    roots = union(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for r, root in zip(kept, roots):
        least[root] = min(least.get(root, r[0]), r[0])
    kept = [r for r, root in zip(kept, roots) if least[root] == r[0]]
    kept = [r for r in kept if not brute_items(bench, r[1])]
    lib = Tokenizer.from_file(bpe.default_path())
    out = set()
    for r in kept:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        out.add((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def test_run_against_brute_force(spark, folder):
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    want = brute(spark, folder)
    assert len(got) == len(want) and set(got) == want
    ids = {r[0] for r in got}
    assert not ids & {60, 61, 64, 70, 71} and {62, 63} <= ids


def test_stages_keep_the_columns(spark, folder):
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, folder), "t")
        assert docs.columns == COLUMNS, name


def test_stages_on_an_empty_table(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0

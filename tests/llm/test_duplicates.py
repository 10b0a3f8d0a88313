import glob
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import WORDS, documents, text, tricky

from keytide.llm import common, components, exact_dedup, simhash, substring_dedup


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_classes(spark):
    rows = tricky()
    got = exact_dedup.classify(documents(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    assert len(got) == len(rows)
    best = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            best.setdefault(i, set()).add((max(known, default=None), len(ids)))
    for r in got:
        assert (r.keep_id, r.group_size) in best[r.doc_id]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_exact_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    rows = tricky()
    docs = documents(spark, rows)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(ascii_lower(t) for _, t in got) == sorted({ascii_lower(t) for _, t in rows})
    for i, t in got:
        ids = [j for j, u in rows if ascii_lower(u) == ascii_lower(t) and j is not None]
        assert i == max(ids, default=None)


def exchanges_over_text(plan):
    """Whether a shuffle of the plan has a scan that reads ``text`` below it."""
    lines = [line for line in plan.splitlines() if line.strip()]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    for i, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "FileScan" in below and "text" in below.split("[", 1)[1].split("]")[0]:
                    return True
    return False


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("ids", [2, 1 << 20])
def test_texts_do_not_move(spark, monkeypatch, tmp_path, limit, ids):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "BROADCAST_ROWS", ids)
    rows = [(i, f"text {i % 70}") for i in range(100)] + [(None, "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = exact_dedup.deduplicate(docs)
    assert not exchanges_over_text(kept._jdf.queryExecution().executedPlan().toString())
    assert exchanges_over_text(docs.repartition("doc_id")._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(30, 100), None], key=str)


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_rows_by_ids_in_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 7)
    rows = spark.range(100).selectExpr(f"cast(id as {kind}) as `k.x`", "id as n").unionByName(spark.sql(f"select cast(null as {kind}) as `k.x`, -1L as n"))
    gone = spark.range(0, 100, 3).selectExpr(f"cast(id as {kind}) as doc_id")
    assert sorted(r.n for r in common.without_ids(rows, gone, "k.x", 34).collect()) == [-1] + [i for i in range(100) if i % 3]
    assert sorted(r.n for r in common.with_ids(rows, gone, "k.x", 34).collect()) == list(range(0, 100, 3))


def test_exact_empty(spark):
    docs = documents(spark, [])
    assert exact_dedup.classify(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0


def brute_fingerprint(t):
    ws = re.findall("[^\x20\x09-\x0d]+", ascii_lower(t))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def union(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    rng = random.Random(9)
    rows = tricky(rng)
    base = text(rng, 200).split(" ")
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = "changed"
        rows.append((100 + k, " ".join(near)))
    got = simhash.classify(documents(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    keep = simhash.deduplicate(documents(spark, rows))
    ids = {i for (i, _), r in zip(rows, roots) if i is None or least[r] == i}
    assert {r.doc_id for r in keep.collect()} == ids and "digest" in keep.columns
    assert simhash.classify(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [1, 2, 4096])
def test_simhash_links_at_any_bucket_size(spark, bucket):
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:8]:
        for _ in range(12):
            fps.add(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))}))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.node: r.root for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bucket=bucket).collect()}
    sets = {}
    for f, r in zip(signed, roots):
        sets.setdefault(r, set()).add(f)
    want = {f: min(s) for s in sets.values() if len(s) > 1 for f in s}
    assert got == want


def test_block_masks_cover_all_pairs():
    rng = random.Random(1)
    for blocks in (5, 6, 7, 8):
        masks = [m % (1 << 64) for m in simhash.block_masks(blocks)]
        for _ in range(200):
            diff = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("least", [1, 1000])
def test_components_of_chains_and_stars(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT_LEAST", least)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def passage_documents(seed=2):
    rng = random.Random(seed)
    fresh = iter(f"w{rng.getrandbits(40):x}" for _ in range(10**6))
    new = lambda n: [next(fresh) for _ in range(n)]
    shared, near = new(51), new(80)
    rows = []
    for i in range(24):
        ws = new(rng.randrange(10, 150))
        at = rng.randrange(len(ws))
        if i % 4 == 0:
            ws[at:at] = shared
        if i % 4 == 1:
            part = list(near)
            part[0] = f"x{i}"
            ws[at:at] = part
        rows.append((i, " ".join(w + ("\n" if rng.random() < 0.1 else "") for w in ws)))
    return rows + [(50, None), (51, ""), (52, "short one"), (None, rows[0][1]), (53, " ".join(new(3000)))]


@pytest.mark.parametrize("bucket", [2, 2048])
def test_substring_dedup_against_runs(spark, bucket):
    rows = passage_documents()
    got = {r.doc_id: r for r in substring_dedup.classify(documents(spark, rows), bucket=bucket).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, r in got.items():
        member = i is not None and i < 24 and i % 4 < 2
        assert r.repeated == member, i
        assert r.component_id == (i % 4 if member else i)
        assert (r.n_removed > 0) == (member and i >= 4) and r.n_removed == len(r.removed_at)
    assert substring_dedup.classify(documents(spark, [])).count() == 0


def test_near_paragraphs_are_linked(spark):
    """Paragraphs that differ in their first word only, and nowhere else equal."""
    rng = random.Random(7)
    ws = [f"w{rng.getrandbits(40):x}" for _ in range(26)]
    sets = [np.unique(substring_dedup.shingle_hashes([f"x{k}", *ws[1:]])) for k in range(3)] + [np.unique(substring_dedup.shingle_hashes([f"y{k}" for k in range(26)]))]
    edges = substring_dedup.jaccard_forest(np.arange(4), sets)
    assert union(4, edges) == [0, 0, 0, 3]


def test_repeated_paragraph_inside_one_document_counts_for_nothing(spark):
    line = " ".join(f"r{k}" for k in range(60))
    got = substring_dedup.classify(documents(spark, [(1, f"{line}\n{line}"), (2, " ".join(WORDS * 3))])).collect()
    assert not any(r.repeated for r in got)


def fresh_words(seed):
    rng = random.Random(seed)
    return lambda n: [f"w{rng.getrandbits(48):x}" for _ in range(n)]


def jaccard(a, b):
    a, b = (set(substring_dedup.shingle_hashes(x).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


def removed_words(r):
    return {p + k for p in r.removed_at for k in range(substring_dedup.WIDTH)}


def test_near_passages_are_found_wherever_they_differ(spark):
    new, rng = fresh_words(21), random.Random(21)
    pairs = []
    for n, changes, cuts in ((51, 1, range(51)), (55, 1, range(0, 55, 3)), (60, 1, range(0, 60, 3)), (94, 2, range(40))):
        for at in cuts:
            a = new(n)
            b = list(a)
            for p in [at] if changes == 1 else rng.sample(range(n), changes):
                b[p] = new(1)[0]
            pairs.append((a, b))
    for at in range(0, 51, 2):  # words put in and taken out
        a, b = new(51), new(51)
        pairs += [(a, a[:at] + new(1) + a[at:]), (b, b[:at] + b[at + 1 :])]
    pairs = [(a, b) for a, b in pairs if jaccard(a, b) >= substring_dedup.SIMILARITY]
    rows, starts = [], {}
    for k, (a, b) in enumerate(pairs):
        for i, part in ((2 * k, a), (2 * k + 1, b)):
            ws = new(rng.randrange(0, 120))
            starts[i] = len(ws)
            rows.append((i, " ".join(ws + part + new(rng.randrange(0, 120)))))
    got = {r.doc_id: r for r in substring_dedup.classify(documents(spark, rows)).collect()}
    assert len(pairs) > 150
    for k, (a, b) in enumerate(pairs):
        first, second = got[2 * k], got[2 * k + 1]
        assert first.repeated and second.repeated and second.component_id == 2 * k and second.keep_ids == [2 * k], k
        part = range(starts[2 * k + 1], starts[2 * k + 1] + len(b))
        assert not first.removed_at and removed_words(second) <= set(part)
    middle = removed_words(got[51])  # the changed word between two equal runs goes with them
    assert middle == set(range(starts[51], starts[51] + 51))


def test_cover():
    rng = random.Random(8)
    for _ in range(200):
        pos = sorted(rng.sample(range(300), rng.randrange(1, 60)))
        kept = substring_dedup.cover(np.array(pos))
        full = lambda at: {p + k for p in at for k in range(substring_dedup.WIDTH)}
        assert full(kept) == full(pos) and set(kept) <= set(pos)


def test_short_texts_and_passages_are_found(spark):
    new = fresh_words(22)
    rows, want = [], {}
    for n in range(24, 52):
        text, part = new(n), new(n)
        for k in range(2):
            rows += [(10 * n + k, " ".join(text)), (10 * n + 5 + k, " ".join(new(7 * k + 3) + part + new(n % 9)))]
            want |= {10 * n + k: (10 * n, range(n)), 10 * n + 5 + k: (10 * n + 5, range(7 * k + 3, 7 * k + 3 + n))}
    rows += [(1, "a notice, four"), (2, "a notice, four"), (3, " ".join(new(40)))]
    for n in range(5, 24):  # short texts as a whole, but not as parts of others
        text = new(n)
        rows += [(2000 + n, " ".join(text)), (2100 + n, " ".join(text).upper()), (2200 + n, " ".join(text + new(30))), (2300 + n, " ".join(text + new(1)))]
    got = {r.doc_id: r for r in substring_dedup.classify(documents(spark, rows)).collect()}
    for i, (keep, part) in want.items():
        assert got[i].repeated and got[i].component_id == keep
        assert removed_words(got[i]) == (set() if i == keep else set(part))
    assert not any(got[i].repeated for i in (1, 2, 3))
    for n in range(5, 24):
        assert [got[i + n].repeated for i in (2000, 2100, 2200, 2300)] == [True, True, False, False]
        assert got[2100 + n].removed_at == [0] and got[2000 + n].removed_at == [] and got[2100 + n].component_id == 2000 + n


def test_every_further_occurrence_is_removed(spark):
    new = fresh_words(23)
    part = new(60)
    texts = [new(9) + part + new(5), new(4) + part + new(8) + part + new(30) + part]
    again = [part + new(40) + part, new(3) + part]  # twice where it stays
    same = [["x"] * 100, ["x"] * 70]
    renamed = [[w + "b" for w in t] for t in again]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *renamed, *same])]
    got = {r.doc_id: r for r in substring_dedup.classify(documents(spark, rows)).collect()}
    at = lambda *starts: {s + k for s in starts for k in range(60)}
    assert removed_words(got[0]) == set() and removed_words(got[1]) == at(4, 72, 162)
    assert removed_words(got[2]) == at(100) and removed_words(got[3]) == at(3)
    assert removed_words(got[4]) == set(range(24, 100)) and removed_words(got[5]) == set(range(70))


def edited(rng, new, ws):
    """A line with a word changed near an end, put in or taken out in the middle, or its halves changed about."""
    half, kind = len(ws) // 2, rng.randrange(3)
    if len(ws) < 30:
        p = rng.choice([0, 1, len(ws) - 1])
        return ws[:p] + new(1) + ws[p + 1 :]
    return [ws[half:] + ws[:half], ws[:half] + new(1) + ws[half:], ws[:half] + ws[half + 1 :]][kind]


@pytest.mark.parametrize("tile", [3, 2048])
def test_near_lines_against_brute_force(spark, tile):
    """Lines too short to have WIDTH equal words in a row with what they resemble."""
    new, rng = fresh_words(24), random.Random(24)
    lines = []
    for k in range(60):
        family = [new(rng.choice([24, 25, 45, 46]))]
        for _ in range(12 if k == 0 else rng.randrange(1, 4)):
            family.append(edited(rng, new, rng.choice(family)))
        lines += [ws for ws in family if len(ws) >= substring_dedup.WIDTH]
    rng.shuffle(lines)
    rows = [(i, "\n".join([" ".join(new(7)), " ".join(ws), " ".join(new(30))])) for i, ws in enumerate(lines)]
    runs = [{tuple(ws[p : p + 24]) for p in range(len(ws) - 23)} for ws in lines]
    pairs = [(i, j) for j in range(len(lines)) for i in range(j)]
    near = [(i, j) for i, j in pairs if jaccard(lines[i], lines[j]) >= substring_dedup.SIMILARITY]
    equal = [(i, j) for i, j in pairs if runs[i] & runs[j]]
    only = union(len(lines), near + equal)
    assert len(set(near) - set(equal)) > 30 and only != union(len(lines), equal)
    got = {r.doc_id: r for r in substring_dedup.classify(documents(spark, rows), tile=tile).collect()}
    groups = union(len(lines), near)
    for i, ws in enumerate(lines):
        assert got[i].component_id == only[i], i
        assert got[i].repeated == (only.count(only[i]) > 1)
        assert removed_words(got[i]) <= set(range(7, 7 + len(ws)))
        if groups[i] != i:  # of near lines all but the first go, whole
            assert removed_words(got[i]) == set(range(7, 7 + len(ws))) and groups[i] in got[i].keep_ids


def test_bands_of_lines_find_near_ones():
    """At the least similarity the bands have 0.9998 by calculation."""
    rng, sizes, hits = np.random.default_rng(25), np.array([44]), 0
    for _ in range(3000):  # 40 shingles each, 36 of them in common: 36 / 44
        a = rng.integers(0, 1 << 63, 40, np.uint64)
        b = np.append(a[:36], rng.integers(0, 1 << 63, 4, np.uint64))
        keys = [substring_dedup.bands(x, np.array([0]), sizes)[1][0] for x in (a, b)]
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 2990


def test_shuffle_files_go_with_their_step(spark):
    """What a step has shuffled isn't left on disk for the steps behind it."""
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    got = substring_dedup.classify(documents(spark, tricky()))
    assert not files() - before
    assert spark.conf.get(name, None) == setting
    assert got.filter("repeated").count()


def test_anchors_of_a_slice_are_those_of_each_text():
    """Words, anchors and runs of many texts at once against one text after the other."""
    sd, rng = substring_dedup, random.Random(31)
    texts = [t for _, t in tricky()] + ["\n\n y_1 \u0130x \u0391\u03a3 \u0391\u03a3\n\u03a3", "a " * 30, *(text(rng, n) for n in range(1, 60))]
    h, in_line, n_lines = sd.word_hashes(texts)
    ws = [[re.findall(r"\w+", line) for line in (t or "").lower().split("\n")] for t in texts]
    assert in_line.tolist() == [len(line) for t in ws for line in t] and n_lines.tolist() == list(map(len, ws))
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip((w for t in ws for line in t for w in line), h.tolist())) and len(set(of.values())) == len(of)
    anchors, runs = set(), set()
    for k, t in enumerate(ws):
        own = np.array([of[w] for line in t for w in line], np.uint64)
        sh, zero = sd.shingles(own), np.zeros(1, np.int64)
        if sd.SHINGLE <= len(own) < sd.WIDTH:
            whole = (k, 0, int(sd.run_hashes(sh, zero, len(own))[0]))
            anchors.add(whole), runs.add(whole)
        elif len(own) >= sd.WIDTH:
            seeds = sd.run_hashes(sh, np.arange(len(own) - sd.SEED + 1), sd.SEED)
            at = {i + int(seeds[i : i + sd.SPAN].argmin()) for i in range(len(seeds) - sd.SPAN + 1)}
            anchors |= {(k, i, int(seeds[i])) for i in at}
            at = np.array(sorted({i - j for i in at for j in range(sd.SPAN) if 0 <= i - j <= len(own) - sd.WIDTH}))
            runs |= set(zip([k] * len(at), at.tolist(), sd.run_hashes(sh, at, sd.WIDTH).tolist()))
    s = sd._Slice(texts)
    rows, at, x = s.anchors()
    assert sorted(zip(rows.tolist(), at.tolist(), x.tolist())) == sorted(anchors)
    assert sorted(zip(*(c.tolist() for c in s.around(rows, at)))) == sorted(runs)

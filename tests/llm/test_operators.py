import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import common, decontam, html_extract, language_id, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from inkfold.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot int, score double, kept string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns, some of whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "x") for i, t in rows], DOCS)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_packing_is_optimal_and_whole(spark):
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(1, 200), 9))
    counts = [rng.randrange(1, 50) for _ in lengths]

    def cost(bounds):
        return sum(c * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))

    import itertools

    for k in (1, 2, 3, 4):
        best = min(cost([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], k - 1))
        assert cost(packing.optimal_boundaries(lengths, counts, k)) == best
    rows = [(i, words(rng, rng.randrange(0, 300))) for i in range(300)]
    out = packing.pack(docs(spark, rows), max_len=64, buckets=4, budget=256, block_rows=20).collect()
    assert {i: sum(r.n_tokens for r in out if r.doc_id == i) for i, _ in rows} == {i: len(t.split()) for i, t in rows}
    places = [(r.bucket, r.batch, r.row) for r in out]
    assert len(set(places)) == len(places)
    for b in {r.bucket for r in out}:
        mine = [r for r in out if r.bucket == b]
        fits = max(1, 256 // mine[0].bucket_len)
        assert max(r.n_tokens for r in mine) <= mine[0].bucket_len and max(r.row for r in mine) < fits
        assert sorted(r.batch * fits + r.row for r in mine) == list(range(len(mine)))


def test_passages_equal_brute_force(spark):
    rng = random.Random(2)
    shared = [words(rng, n) for n in (50, 60, 90, 300)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(1, 80))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, words(rng, 49)), (102, words(rng, 400))]
    found = suffix_dedup.passages(docs(spark, rows)).collect()
    text = {i: t.lower().split() for i, t in rows}
    grams = {}
    for i, t in text.items():
        for k in range(len(t) - 49):
            grams.setdefault(tuple(t[k : k + 50]), set()).add(i)
    for i, t in text.items():
        expected = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if len(grams[tuple(t[k : k + 50])]) > 1:
                expected[k : k + 50] = True
        got = np.zeros(len(t), bool)
        for r in found:
            if r.doc_id == i:
                got[r.begin : r.end] = True
        assert (got == expected).all(), i


def missed_and_added(spark, rows):
    """Words that brute force finds in repeated passages and passages() does not, and the other way round."""
    text = {i: t.lower().split() for i, t in rows}
    grams = {}
    for i, t in text.items():
        for k in range(len(t) - 49):
            grams.setdefault(tuple(t[k : k + 50]), set()).add(i)
    expected = {(i, w) for i, t in text.items() for k in range(len(t) - 49) if len(grams[tuple(t[k : k + 50])]) > 1 for w in range(k, k + 50)}
    got = {(r.doc_id, w) for r in suffix_dedup.passages(docs(spark, rows)).collect() for w in range(r.begin, r.end)}
    return len(expected), len(expected - got), len(got - expected)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_passages_of_a_text_that_repeats_itself(spark, partitions):
    rng = random.Random(7)
    shared = words(rng, 80)
    rows = [(1, " ".join([shared] * 300)), (2, f"{words(rng, 30)} {shared} {words(rng, 30)}")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert missed_and_added(spark, rows) == (300 * 80 + 80, 0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages_of_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for copies in (3, 10, 100):
        base = words(rng, 300).split()
        for _ in range(copies):
            copy = list(base)
            for k in rng.sample(range(300), rng.randrange(6, 13)):
                copy[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    n, missed, added = missed_and_added(spark, rows)
    assert n > 5000 and (missed, added) == (0, 0)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        base = words(rng, rng.randrange(3, 1500)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + k, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} or {tuple(t.split())} for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            changed |= comp[a] != comp[b]
            comp[a] = comp[b] = low
    assert got == comp


@pytest.mark.parametrize(("most", "blocks"), [(2, 1), (5, 1), (2, 1000)])
def test_join_with_large_open_signatures(spark, monkeypatch, most, blocks):
    """Sets that share frequent shingles but are not near copies, with trees so small that second shingles and blocks are needed."""
    monkeypatch.setattr(ngram_join, "TREE", most)
    monkeypatch.setattr(ngram_join, "BLOCKS", blocks)
    rng = random.Random(17)
    common = [words(rng, 12) for _ in range(4)]
    rows = []
    for _ in range(40):
        base = " ".join([*rng.sample(common, 3), words(rng, rng.randrange(1, 9))]).split()
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            if rng.randrange(2):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


def test_tree_search_loses_no_partner():
    rng = np.random.default_rng(5)
    points = rng.poisson(6, (300, ngram_join.GROUPS))
    sizes = points.sum(1)
    tree = ngram_join.RTree(points, sizes)
    for k in range(0, 300, 7):
        ok = (sizes * 100 >= sizes[k] * 85) & (sizes * 85 <= sizes[k] * 100) & (np.minimum(points, points[k]).sum(1) >= ngram_join.least_overlap(int(sizes[k]), sizes, 85))
        assert set(np.nonzero(ok)[0]) <= set(tree.search(points[k], int(sizes[k]), 85).tolist())


def test_one_node_loses_no_partner():
    rng = np.random.default_rng(6)
    points = rng.poisson(2, (60, ngram_join.GROUPS))
    sizes = points.sum(1)
    wanted = np.ones((60, 60), bool)
    k, m = ngram_join.within_node(points, sizes, wanted, 85)
    ok = {(a, b) for a in range(60) for b in range(a + 1, 60) if 85 * max(sizes[a], sizes[b]) <= 100 * min(sizes[a], sizes[b]) and np.minimum(points[a], points[b]).sum() >= ngram_join.least_overlap(int(sizes[a]), int(sizes[b]), 85)}
    assert set(zip(k.tolist(), m.tolist(), strict=True)) == ok


def test_shards_are_minimax_and_gapless(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(0, 60))) for i in range(400)] + [(900 + i, "copy") for i in range(150)]
    out = sharding.shard(docs(spark, rows), shards=7, block_rows=10).collect()
    unit = {}
    for r, (_, t) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows), strict=True):
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        unit.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in unit.values())
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    most = max(sum(r.size for r in out if r.shard == s) for s in range(7))
    assert most <= out[0].capacity and max(r.shard for r in out) < 7


def test_html_main_text():
    page = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav>
    <div class="cookie-notice"><p>We use cookies, many of them, all the time, everywhere.</p></div><aside><p>Side, with, many, commas, in, it.</p></aside>
    <div id="content"><h1>Head&amp;line</h1><p>First   paragraph, which is long enough, and has commas, to be found.</p><ul><li>One</li><li>Two</li></ul>
    <p>Second one,<br>with a break, and more text to read for everyone who likes it.</p><form><input value=x><p>Sign up</p></form></div>
    <div class="comments"><p>I, for one, do not agree, at all, with any of this, ever.</p></div><footer>&copy; us</footer></body></html>"""
    assert html_extract.main_text(page) == "Head&line\n\nFirst paragraph, which is long enough, and has commas, to be found.\n\nOne\n\nTwo\n\nSecond one, with a break, and more text to read for everyone who likes it."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_html_spares_what_holds_the_page():
    one, two = "First paragraph, which is long enough, and has commas, to be found.", "Second one, with more text to read, for everyone who likes it."
    for name in ("layout has-sidebar", "no-sidebar", "with-comments"):
        assert html_extract.main_text(f"<div class='{name}'><p>{one}</p><p>{two}</p></div><div class='comments'><p>I do not agree.</p></div>") == f"{one}\n\n{two}"
        assert html_extract.main_text(f"<div class='{name}'><article><p>{one}</p><p>{two}</p></article></div>") == f"{one}\n\n{two}"
    page = f"<article><p>{one}</p><h2 id='related-work'>Related work</h2><section id='discussion'><p>{two}</p></section><h2 id='feedback'>Feedback</h2><p>{two}</p><div class='ad'><p>Buy it.</p></div></article>"
    assert html_extract.main_text(page) == f"{one}\n\nRelated work\n\n{two}\n\nFeedback\n\n{two}"
    assert html_extract.main_text(f"<main><article><p>{one}</p><p>{two}</p></article><section id='comments'><article><p>I do not agree.</p></article></section></main>") == f"{one}\n\n{two}"
    assert html_extract.main_text(f"<nav class='menu'><article><p>{two}</p></article></nav><div><p>{one}</p></div>") == one


def test_language_and_toxicity_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert lang > 0.98
    tox = toxicity.classify(d, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert tox > 0.9


def test_unlearnt_scripts_go_and_letters_of_every_plane_count(spark):
    rng = random.Random(9)
    known = [(k, " ".join(rng.choice(["the", "house", "stands", "near", "water", "and", "people", "walk"]) for _ in range(60)), "en") for k in range(40)]

    def foreign(first, n):
        return " ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(2, 9))) for _ in range(80))

    strange = [(100 + k, foreign(0x1200, 64), None) for k in range(100)]
    gothic = (300, foreign(0x10330, 20), None)
    d = spark.createDataFrame([*known, *strange, gothic], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.keep_identified(d).collect()}
    assert {k for k, _, _ in known} <= kept and len(kept - set(range(40))) <= 3
    assert language_id.identify(d).where("doc_id = 300").first().lang_pred == "en"


def test_counterfactuals_swap_one_kind():
    assert {"the", "lesbian", "man"} in list(toxicity.counterfactuals({"the", "gay", "man"}))


def test_base_rules():
    from inkfold.llm.common import WordHashes

    (n, chars, symbols, dup, repeat), _ = quality.base("a b c a b c\n#é\n#é\n\n".encode(), WordHashes())
    assert (n, chars, symbols, dup, repeat) == (8, 10, 2, 1, 6)


def test_lines_go_through_the_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    rng = random.Random(10)
    held = {}
    kinds = "h1 long, h2 long, docs long, last long"
    for k in range(5):
        batch = [(h, h, rng.randrange(1, 4), rng.randrange(100)) for h in rng.sample(range(40), 20)]
        rows = spark.createDataFrame(batch, kinds)
        assert {r.h1 for r in runs.unseen(rows).collect()} == {h for h, *_ in batch} - set(held)
        runs.load(rows)
        for h, _, n, last in batch:
            held[h] = (held.get(h, (0, 0))[0] + n, max(held.get(h, (0, 0))[1], last))
        own = [r.h1 for run in runs.runs() for r in run.collect()]
        assert sorted(own) == sorted(held)  # each line is in one run
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.h1: (r.docs, r["last"]) for r in runs.counts().collect()} == held
    assert {r.h1 for r in runs.counts(5).collect()} == {h for h, (n, _) in held.items() if n >= 5}
    runs.close()
    assert not runs.runs() and not runs.places


def test_line_batches_meet_the_runs_without_shuffling_them(spark):
    rows = line_dedup.line_hashes(docs(spark, [(k, f"line number {j} that is surely more than forty characters long") for k in range(30) for j in (k, k // 3)]))
    base = line_dedup.batched(rows, 3)
    runs = line_dedup.LineRuns(spark, fanout=4, rows=base.count())
    for k in range(2):
        runs.load(base.where(F.col("batch") == k).drop("batch"))
    plan = runs.unseen(runs.dealt(base.where("batch = 2")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1  # the batch alone
    runs.close()


def files(path):
    return list(Path(path.removeprefix("file://")).rglob("*.parquet"))


def test_lines_are_written_in_few_files(spark):
    rows = line_dedup.line_hashes(docs(spark, [(k, f"line number {j} that is surely more than forty characters long") for k in range(400) for j in (k, k // 3)]))
    base = line_dedup.batched(rows, 3)
    assert len(files(base.written_at)) == 1  # a task's batches share a file
    runs = line_dedup.LineRuns(spark, fanout=2, rows=500_000)
    assert runs.buckets == 3
    for k in range(2):
        runs.load(base.where(F.col("batch") == k).drop("batch"))
    (name,) = runs.levels[1]
    assert len(files(runs.places[name])) == 3  # two runs of three buckets made one
    assert spark.table(name).count() == base.where("batch < 2").select("h1", "h2").distinct().count()
    runs.close()


def test_packing_writes_no_more_ranges_than_cores_or_rows_ask_for(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(packing, "written", lambda df, name, **how: tables.setdefault(name, common.written(df, name, **how)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        out = packing.pack(docs(spark, [(k, "w " * (k % 60)) for k in range(3000)])).collect()
        assert len(files(tables["ranges"].written_at)) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.doc_id for r in out) == list(range(3000)) and sum(r.n_tokens for r in out) == sum(k % 60 for k in range(3000))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    lines = [f"{words(rng, 9)} {k}" for k in range(30)] + ["short", ""]
    rows = [(rng.randrange(200), "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 6)))) for _ in range(120)]
    rows = [*{i: (i, t) for i, t in rows}.values()]
    holders = {}
    for i, t in rows:
        for x in {x.strip(" \t").lower() for x in t.split("\n")}:
            holders.setdefault(x, set()).add(i)
    gone = {x: max(h) for x, h in holders.items() if len(x) >= 40 and len(h) >= 5}
    for batches in (1, 3, 9):
        got = {r.doc.doc_id: r.new_text for r in line_dedup.dedup_lines(docs(spark, rows), batches=batches).collect()}
        assert got == {i: "\n".join(x for x in t.split("\n") if gone.get(x.strip(" \t").lower(), i) == i) for i, t in rows}


@pytest.mark.parametrize("tokens", range(1, 14))
def test_masks_lose_no_overlap(tokens):
    assert decontam.complete(tokens, decontam.MASKS[tokens])


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(k, words(rng, n, 60)) for k, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 30, 45])]
    rows = []
    for k in range(150):
        text = words(rng, rng.randrange(0, 60), 60).split()
        if k % 2:
            item = rng.choice(items)[1].split()
            for at in rng.sample(range(len(item)), min(len(item), rng.randrange(0, 4))):
                item[at] = "other"
            cut = rng.randrange(0, max(1, len(item) - 12))
            text[len(text) // 2 : len(text) // 2] = item[cut:]
        rows.append((k, " ".join(text)))
    expected = {}
    for i, t in rows:
        d = t.split()
        for j, s in items:
            w = s.split()
            n = min(13, len(w))
            best = max(sum(0 <= a + k < len(d) and d[a + k] == w[k] for k in range(b, b + n)) for a in range(-len(w), len(d) + 1) for b in range(len(w) - n + 1))
            if 100 * best >= 80 * n:
                expected[i, j] = best
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (0, 10**6):
        got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.overlaps(docs(spark, rows), bench, broadcast_rows=bound).collect()}
        assert got == expected
    with pytest.raises(ValueError):
        decontam.overlaps(docs(spark, rows), bench, masks={**decontam.MASKS, 8: ((0, 1, 3, 6, 7),)})


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_passages_behind_decoys(spark, partitions):
    """Passages of 54 words, with other texts that share only their last 45 words and run on with one of the two."""
    rng = random.Random(13)
    rows = []
    for k in range(12):
        shared, tail = words(rng, 54), [words(rng, 40) for _ in range(2)]
        rows += [(100 * k + j, f"{words(rng, 30)} {shared} {tail[j]}") for j in range(2)]
        rows += [(100 * k + 10 + j, f"{words(rng, 30)} {' '.join(shared.split()[9:])} {' '.join(tail[j % 2].split()[: 10 + 5 * j])} {words(rng, 30)}") for j in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n, missed, added = missed_and_added(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n >= 24 * 54 and (missed, added) == (0, 0)


def test_rows_of_one_id_are_one_node(spark):
    same, other, third = words(random.Random(14), 60), words(random.Random(15), 60), words(random.Random(16), 60)
    rows = [(3, same), (5, same), (5, other), (5, None), (8, other), (9, third), (9, ""), (None, same), (2, None)]
    found = {(r.doc_id, r.component_id) for r in ngram_join.join(docs(spark, rows)).collect()}
    assert found == {(3, 3), (5, 3), (8, 3), (9, 9), (None, None), (2, 2)}


def test_offsets_of_blocks(spark):
    rows = [(k, b, 1 + (k + b) % 5) for k in range(3) for b in range(50)]
    got = {(r.k, r.b): r.before for r in common.before(spark.createDataFrame(rows, "k int, b long, rows long"), ["k"], "b", wide=7).collect()}
    assert got == {(k, b): sum(n for j, c, n in rows if j == k and c < b) for k, b, _ in rows}

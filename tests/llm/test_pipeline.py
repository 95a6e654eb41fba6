"""The pipeline against plain Python over a small fixture, and every operator and stage on the same odd tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import decontam, html_extract, language_id, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from inkfold.llm.common import held_out

EN = "the house stands near water and people walk there with their children every day when sun shines over old town".split()
FR = "le maison est pres de cette eau et les gens marchent ici avec leurs enfants chaque jour quand soleil brille".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, of):
    return " ".join(rng.choice(of) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


def fixture(rng):
    common = [f"{prose(rng, 9, EN)} {k} {'x' * 30}" for k in range(4)]
    items = [(k, prose(rng, 20, EN + [f"q{k}", f"r{k}", f"s{k}"])) for k in range(6)]
    rows = []
    for k in range(60):
        lines = [prose(rng, rng.randrange(5, 40), rng.choice([EN, FR])) for _ in range(rng.randrange(1, 5))]
        if k % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(common).upper() + "  ")
        if k % 10 == 4:
            lines.append(rng.choice(items)[1])
        rows.append((k, "\n".join(lines), "fr" if k % 2 else "en", "s", None))
    for k in range(60, 90):  # near copies
        base = rng.choice(rows[:60])[1].split(" ")
        for _ in range(rng.randrange(0, 1 + len(base) // 30)):
            base[rng.randrange(len(base))] = "changed"
        rows.append((k, " ".join(base), "en", "s", None))
    rows += [(200, common[0], "en", "s", None), (201, common[0], "en", "s", None), (300, None, None, "s", None), (301, "", "en", "s", None), (302, "123 456", None, "s", None)]
    rows += [(400 + k, "".join(chr(0x1200 + rng.randrange(64)) if rng.randrange(6) else " " for _ in range(600)), None, "s", None) for k in range(3)]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows], items


def without_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  the fixture is ASCII here
    holders = {}
    for i, t in rows:
        for x in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(x, []).append(i)
    gone = {x: max(h) for x, h in holders.items() if len(x) >= 40 and len(h) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if gone.get(key(x), i) == i]
        if len(left) == len(lines) or "\n".join(left).strip(" "):
            out.append((i, t if len(left) == len(lines) else "\n".join(left)))
    return out


def without_copies(rows):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t or "")) for i, t in rows]
    comp = {i: i for i, _ in sets}
    pairs = [(i, j) for i, a in sets for j, b in sets if i < j and a and 100 * len(a & b) >= 80 * len(a | b)]
    for _ in rows:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [(i, t) for i, t in rows if comp[i] == i]


def without_benchmark(rows, items):
    def tokens(t):
        return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    def found(d, w):
        n = min(13, len(w))
        return any(100 * sum(0 <= a + k < len(d) and d[a + k] == w[k] for k in range(b, b + n)) >= 80 * n for a in range(-len(w), len(d)) for b in range(len(w) - n + 1))

    return [(i, t) for i, t in rows if not any(found(tokens(t), tokens(w)) for _, w in items)]


def least_padding(lengths, buckets):
    """The least sum of padded lengths over all choices of so many boundaries, by the plain recursion."""
    counts = sorted(Counter(lengths).items())
    best = {0: 0}
    for _ in range(buckets):
        best = best | {j: min(best[i] + sum(c for _, c in counts[i:j]) * counts[j - 1][0] for i in range(j) if i in best) for j in range(1, len(counts) + 1)}
    return best[len(counts)]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, items = fixture(random.Random(21))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = [(i, t) for i, t, *_ in rows if i < 300]  # what is in a language that the table names
    steps = [lambda x: x, without_lines, without_copies, lambda x: without_benchmark(x, items)]
    sizes = [len(rows)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        out = step(out)
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in got) == sorted(out), name
        assert all(r.n_chars == len(r.text) and r.lang in ("en", "fr") for r in got)
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) > 3  # each of them takes some
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = {i: len(t.split()) for i, t in out}
    assert sorted((r.doc_id, r.piece, r.start, r.n_tokens) for r in packed) == sorted((i, 0, 0, n) for i, n in lengths.items())
    assert sum(r.bucket_len for r in packed) == least_padding([max(1, n) for n in lengths.values()], packing.BUCKETS)
    assert len({(r.bucket, r.batch, r.row) for r in packed}) == len(packed)
    for b in {r.bucket for r in packed}:
        places = sorted(r.batch * max(1, packing.BUDGET // r.bucket_len) + r.row for r in packed if r.bucket == b)
        assert places == list(range(len(places)))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key long, _row long, `row` long, doc string, h1 long, gone string, kept string, score double, slot int, `a.b` string, id long, key string, before long"


def odd(spark, empty=False):
    rest = (7, 7, 7, 7, "d", 7, "g", "k", 0.5, 7, "a.b", 7, "key", 7)
    texts = [(1, None), (2, ""), (3, "  \n\t "), (3, "  \n\t "), (None, "a b c d e"), (4, "long words here " * 20_000), (5, "a b c d e"), (5, "a b c d e"), (5, "the other text of five"), (6, "\U00010400\U00020000")]
    rows = [(i, t, "en" if t else None, "s", len(t or ""), *rest) for i, t in texts]
    return spark.createDataFrame([] if empty else rows, CLASHING), [] if empty else rows


def same(df, rows):
    return sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("empty", [False, True])
def test_operators_take_odd_tables(spark, empty):
    d, rows = odd(spark, empty)
    labels = spark.createDataFrame([] if empty else [(5, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([] if empty else [(1, "a b c d e"), (None, None), (2, "")], "item_id long, text string")
    n = len(rows)
    packed = packing.pack(d).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((r[1] or "").split()) for r in rows) and sum(r.piece == 0 for r in packed) == n
    assert suffix_dedup.passages(d).collect() == []
    joined = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d).collect())
    assert joined == Counter({} if empty else {(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 2, (None, 2, None): 1, (4, 3, 4): 1, (5, 2, 5): 3, (6, 1, 6): 1})
    slots = [(r.shard, r.slot) for r in sharding.shard(d).collect()]
    assert len(slots) == len(set(slots)) == n
    spoken = {(r.doc_id, r.lang_pred) for r in language_id.identify(d).collect()}
    assert spoken == (set() if empty else {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (5, "en"), (6, "en")})
    assert all(0 <= r.score <= 1 for r in toxicity.classify(d, labels).collect())
    judged = quality.rules(d, labels).collect()
    assert len(judged) == n and not any(r.kept for r in judged)
    lines = line_dedup.dedup_lines(d)
    assert sorted(map(str, ((r.doc.doc_id, r.new_text, r.n_lines, r.n_dropped) for r in lines.collect()))) == sorted(map(str, ((r[0], r[1] or "", 1 + (r[1] or "").count("\n"), 0) for r in rows)))
    assert same(lines.select("doc.*"), rows)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, bench).collect()} == (set() if empty else {(None, 1), (5, 1)})
    assert same(decontam.decontaminate(d, bench), [r for r in rows if r[1] != "a b c d e"])
    assert same(ngram_join.keep_one(d), rows)
    assert language_id.keep_identified(d).columns == d.columns
    pages = d.withColumnRenamed("text", "html")
    assert html_extract.extract(pages).count() == n


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_tables(spark, tmp_path, empty):
    d, rows = odd(spark, empty)
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
            continue
        assert out.columns == d.columns, name
        left = {"language": [r for r in rows if r[1] and r[1].strip()], "benchmark": [r for r in rows if r[1] != "a b c d e"]}.get(name, rows)
        got = out.collect()
        assert Counter(r.doc_id for r in got) <= Counter(r[0] for r in left) and (name == "language" or len(got) == len(left)), name


def brute_cosines(rows, held, dim=language_id.DIM):
    """Cosines with each prototype, letter by letter and trigram by trigram."""
    letters = language_id.letters(dim)

    def vector(text):
        classes, before = [0], True
        for x in text:
            c = language_id.letter_class(x)
            if c or not before:
                classes.append(c)
            before = c == 0
        classes.append(0)
        v = np.zeros(dim)
        for a, b, c in zip(classes, classes[1:], classes[2:], strict=False):
            v += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return v

    sums = {}
    for i, t, lang in rows:
        if lang and t and i not in held and any(map(str.isalpha, t)):
            sums[lang] = sums.get(lang, 0) + vector(t)
    out = {}
    for i, t, _ in rows:
        if t and any(map(str.isalpha, t)):
            v = vector(t)
            out[i] = {x: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for x, s in sums.items()}
    return out


def test_languages_equal_brute_force(spark):
    import zlib

    rng = random.Random(22)
    rows = [(k, prose(rng, rng.randrange(1, 30), EN if k % 2 else FR) + rng.choice(["", " 12. É\U00010400", "\n\n--\nß"]), "en" if k % 2 else "fr") for k in range(40)] + [(90, "", "en"), (91, "12 3", "xx"), (92, None, None), (93, "straße", None)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    expected = brute_cosines(rows, held)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == set(got) - set(expected)
    for i, cosines in expected.items():
        best = max(cosines.values())
        assert abs(got[i].cosine - best) < 1e-4 and abs(cosines[got[i].lang_pred] - best) < 1e-4
        assert got[i].held_out == (i in held)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(23)
    rows = [(k, "".join(rng.choice(["word ", "é ", "# ", "a b c ", "$%x\t", "\n", "\n\n", "w\x0b"]) for _ in range(rng.randrange(0, 150)))) for k in range(80)] + [(90, None), (91, "")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    import re

    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(grams)
        repeated = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and r.kept <= (not r.base_failed)


def test_counterfactual_penalty_closes_the_gap(spark):
    """Toxic texts name one group more often; with the penalty a neutral sentence scores alike whichever group it names."""
    rng = random.Random(24)
    calm, harsh = "we met for tea and talked about music books gardens and travel".split(), "vile awful hateful stupid".split()
    rows, marks = [], []
    for k in range(900):
        toxic = k % 2
        text = [rng.choice(calm) for _ in range(12)] + ([rng.choice(harsh)] if toxic and rng.randrange(10) else [])
        if rng.randrange(10) < (6 if toxic else 1):
            text.append("gay")
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        marks.append((k, 1, toxic))
    neutral = [(2000, "we met gay travel tea"), (2001, "we met lesbian travel tea"), (2002, "we met hateful travel tea")]
    d, labels = spark.createDataFrame(rows + neutral, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")

    def scores(strength):
        return {r.doc_id: r.score for r in toxicity.classify(d, labels, strength=strength).where("doc_id >= 2000").collect()}

    plain, fair = scores(0.0), scores(toxicity.STRENGTH)
    assert plain[2000] - plain[2001] > 0.1
    assert abs(fair[2000] - fair[2001]) < 0.25 * (plain[2000] - plain[2001])
    assert fair[2002] > fair[2000] + 0.1


def test_classifiers_on_rows_they_did_not_learn(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.rules(d, labels).join(labels.withColumnRenamed("quality", "label"), "doc_id").where(held_out(F.col("doc_id")) & ~F.col("base_failed"))
    assert judged.agg(F.avg((F.col("label") == F.col("kept").cast("int")).cast("int"))).first()[0] > 0.97
    marked = toxicity.classify(d, labels).join(labels, "doc_id").where("held_out")
    assert marked.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.93
    langs = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert min(r.right for r in langs) > 0.97


def test_shards_reach_the_smallest_capacity(spark):
    """No smaller capacity lets the ordered units go into the shards, by the plain greedy walk."""
    import hashlib

    rng = random.Random(25)
    rows = [(k, prose(rng, rng.randrange(0, 40), EN)) for k in range(500)]
    for shards in (3, 40):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
        units = {}
        for _, t in rows:
            unit = int(hashlib.md5(t.encode()).hexdigest()[:4], 16)
            units[unit] = units.get(unit, 0) + len(t.encode()) + 16
        sizes = [units[u] for u in sorted(units)]

        def needed(capacity):
            n, room = 1, capacity
            for x in sizes:
                if x > room:
                    n, room = n + 1, capacity
                room -= x
            return n

        c = got[0].capacity
        assert needed(c) <= shards and (c == max(sizes) or needed(c - 1) > shards)
        most = max(sum(r.size for r in got if r.shard == s) for s in {r.shard for r in got})
        assert most <= c


def test_toxicity_scores_equal_brute_force(spark):
    import math
    import re

    import xxhash

    rng = random.Random(26)
    rows = [(k, prose(rng, rng.randrange(1, 25), EN + (["vile", "awful"] if k % 3 == 0 else [])) + rng.choice(["", " É9 x_y", "\nGay men"])) for k in range(400)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    assert np.abs(model.weights).max() > 0
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(d, model).select("doc.doc_id", "score", "predicted").collect()}
    for i, t in rows:
        found = set()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            for feature in (f"={w}", *(f"{w[:n]}-" for n in (4, 5, 6) if len(w) >= n)):
                found.add(xxhash.xxh64_intdigest(feature) % len(model.weights))
        z = model.slope * (sum(float(model.weights[k]) for k in found) + model.bias) + model.offset
        score = 1 / (1 + math.exp(-max(-35, min(35, z))))
        assert abs(got[i][0] - score) < 1e-4 and got[i][1] == (got[i][0] >= 0.3)


def test_quality_scores_equal_brute_force(spark):
    import math

    from inkfold.llm.common import WordHashes, mixed, windows

    rng = random.Random(27)
    rows = [(k, prose(rng, rng.randrange(50, 90), EN if k % 2 else FR) + rng.choice(["", " éß", "\n#$"])) for k in range(200)] + [(900, "ab"), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.judge(d, model).select("doc.doc_id", "quality", "kept", "base_failed").collect()}
    dim, hashes = len(model.weights) // 2, WordHashes()
    for i, t in rows:
        z, raw, h = model.bias, t.encode(), hashes.of(t.encode().split())
        kinds = [[int(mixed(h[k : k + 1])[0]) % dim for k in range(len(h))], [int(windows(h[k : k + 2], 2)[0]) % dim for k in range(len(h) - 1)]]
        for n in (3, 4):
            grams = [int.from_bytes(raw[k : k + n], "little") + (1 << (37 + n)) for k in range(len(raw) - n + 1)]
            kinds.append([int(mixed(np.array([g], np.uint64))[0]) % dim + dim for g in grams])
        z += sum(float(model.weights[k]) / len(kind) for kind in kinds for k in kind) if t else 0.0
        p = 1 / (1 + math.exp(-max(-35, min(35, model.slope * z + model.offset))))
        assert abs(got[i].quality - p) < 1e-3, i
        assert got[i].kept == (not got[i].base_failed and got[i].quality >= quality.KEEP)

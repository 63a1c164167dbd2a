"""SimHash links and line dedup against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")

from quillmass.llm import lines, simhash  # noqa: E402

from .helpers import documents  # noqa: E402


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    """id -> smallest id reachable, over (id, fingerprint) rows."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in distinct}


def test_fingerprints_and_components(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(25):
        base = random.choices(vocabulary, k=150)
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            copy = list(base)
            copy[random.randrange(150)] = random.choice(vocabulary).upper()
            texts.append(" ".join(copy))
    rows = [(100 + i, t, "en", "s", 1, None) for i, t in enumerate(texts)]
    df = documents(spark).unionByName(documents(spark, rows))
    found = simhash.near_duplicates(df).collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    want = brute_components(prints)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == sorted((str(i), f"{f:016x}", want[f]) for i, f in prints)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_bucket", [2, 64])
def test_links_with_large_buckets(spark, max_bucket):
    """The exact way for large buckets connects what brute force connects."""
    random.seed(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        f = random.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            f ^= 1 << random.randrange(64)
            if random.random() < 0.3:
                f ^= 1 << random.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "f long")
    roots = simhash.components(simhash.links(df, 2, max_bucket)).collect()
    groups = {}
    for r in roots:
        groups.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for f, root in brute_components([(i, f) for i, f in enumerate(sorted(prints))]).items():
        want.setdefault(root, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("order", ["falling", "random"])
def test_long_chains_are_one_component(spark, order):
    """Several hundred fingerprints, each within reach of the next only."""
    ids = list(range(400, 0, -1))
    if order == "random":
        random.Random(3).shuffle(ids)
    df = spark.createDataFrame([*zip(ids, ids[1:]), (1001, 1000)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(df).collect()}
    assert found == dict.fromkeys(ids, 1) | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("most", [0, 60])  # edges that one task takes together
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, most):
    """Both ways give the smallest node that is reached; edges in any direction, repeated, from a node to itself, negative, none."""
    monkeypatch.setattr(simhash, "MAX_TASK_EDGES", most)
    rng = random.Random(5)
    edges = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(45)] + [(-(1 << 63), 100), (100, (1 << 63) - 1), (100, -(1 << 63)), (7, 7), (200, 200)]
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.root for r in simhash.components(df).collect()} == want
    assert simhash.components(df.filter("a > 1000")).collect() == []


def test_near_dedup_takes_few_tasks(spark, monkeypatch):
    """Candidates are compared in one go and their links united in one task: what tasks cost besides rows does not grow with rounds and unions."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(90):  # a bucket of over 64 sets, near copies in a chain
        base = [*base[:-1]] if rng.random() < 0.3 else [*base, f"v{rng.randrange(900)}"]
        texts.append(" ".join(base))
    df = documents(spark, [(i, t, "en", "s", 1, None) for i, t in enumerate(texts)])
    asked, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: asked.append(1) or verified(pairs, *a))
    want = brute_sets(list(enumerate(texts)))
    context = spark.sparkContext
    context.setJobGroup("few tasks", "")
    try:
        assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(want.values()))
        stages = {s for j in context.statusTracker().getJobIdsForGroup("few tasks") for s in context.statusTracker().getJobInfo(j).stageIds}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tasks = [i.numTasks for s in stages if (i := context.statusTracker().getStageInfo(s))]
    print(len(asked), sum(tasks), max(tasks))
    assert len(asked) == 1 and max(tasks) <= 16  # four shuffle partitions, or as many for each part of a union


def test_allocation_sums_and_choices():
    cost, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 50}, {-1: 0, 0: 1, 1: 2}], 1)
    assert (cost, chosen) == (7, [0, 1])
    groups = simhash.group_bits(__import__("numpy").eye(64), 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} <= {21, 22}


def test_keep_first(spark):
    df = documents(spark)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    found = sorted(str(r.doc_id) for r in kept.collect())
    assert found == ["1", "2", "4", "5", "6", "None"]  # 3 is blank like 2, and 4 stands once


def brute_sets(rows):
    """id -> smallest id reachable over Jaccard similarities of 0.8 or more of 5-word shingles."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and find(a) != find(b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("most", [3, 64])  # sets of a bucket that is not large
def test_planted_near_copies_equal_brute_force(spark, monkeypatch, most):
    """Copies with one to eight edited words on either side of 0.8, a large group of them, and a passage in many texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([60, 120, 240]))
        for _ in range(1 if group % 3 else 6):
            texts.append(" ".join(base))
            for _ in range(25 if group == 0 else 3):
                copy = list(base)
                for _ in range(rng.randint(1, 8)):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    for size in (508, 1030):  # around the sizes at which sketches double
        base = [f"v{rng.randrange(9000)}" for _ in range(size)]
        for _ in range(6):
            at, more = rng.randrange(size), rng.choice([0, 3, 12, 60, 130])
            texts.append(" ".join(base[:at] + [f"x{rng.randrange(9000)}" for _ in range(more)] + base[at:]))
    base = rng.choices(vocabulary, k=150)  # copies of copies, and parts of one text: chains far from any hub
    for _ in range(40):
        base = list(base)
        base[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(base))
        texts.append(" ".join(base[: rng.randint(90, 150)]))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.choice([2, 5, 9, 200]))) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 1, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(simhash.similar_classes, "__defaults__", (5, most))
    want = brute_sets([(i, t) for i, t, *_ in rows])
    assert len(set(want.values())) < len(rows) - 40
    assert sorted(r.doc_id for r in simhash.keep_first(documents(spark, rows)).collect()) == sorted(set(want.values()))


def test_pipeline_searches_fingerprints_first(spark, monkeypatch):
    """near_dedup goes by the operator's fingerprints; an exact comparison decides, and finds what these do not reach."""
    import corpus_pipeline

    rng = random.Random(17)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = next(t for k in range(400) for t in [base[:k] + ["zz"] + base[k + 1 :]] if 0 < (simhash.fingerprint(" ".join(t).encode(), 5) ^ simhash.fingerprint(" ".join(base).encode(), 5)).bit_count() <= 2)
    far = [f"v{i}" if i % 60 == 30 else w for i, w in enumerate(base)]  # similar, but more bits apart
    stuck = [" ".join(["same"] * 60 + [f"{c}{i}" for i in range(40)]) for c in "xyz"]  # one fingerprint, sets of little in common
    texts = [" ".join(near), " ".join(base), " ".join(far), *stuck]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert (prints[1] ^ prints[2]).bit_count() > 2 and prints[3] == prints[4] == prints[5]
    df = documents(spark, [(i, t, "en", "s", 1, None) for i, t in enumerate(texts)])
    found = simhash.prefixes(df, 5, simhash.common_shingles(df, 5))
    ids = {r.f: r.doc_id for r in found.collect()}
    pairs = {frozenset((ids[r.a], ids[r.b])) for r in simhash.fingerprint_pairs(found).collect()}
    assert frozenset((0, 1)) in pairs and len(pairs & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2 and frozenset((1, 2)) not in pairs
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(a) or links(*a))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 3, 4, 5]
    assert len(asked) == 1


# ---- lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(rows, min_words=5):
    """doc_id -> (lines, dropped line numbers), by comparing every line with every earlier one."""
    order, out = [], {}
    for doc_id, text in rows:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" \t\r")
            if line:
                order.append((doc_id, place, line))
    order.sort(key=lambda x: x[:2])
    for k, (doc_id, place, line) in enumerate(order):
        words = line.split(" ")
        for _, _, earlier in order[:k]:
            other = earlier.split(" ")
            if earlier == line or (min(len(words), len(other)) >= min_words and within_one(words, other)):
                out.setdefault(doc_id, set()).add(place)
                break
    return out


@pytest.mark.parametrize(("long", "most"), [(8, 250_000), (1024, 250_000), (1024, 0)])
def test_lines_equal_brute_force(spark, monkeypatch, long, most):
    monkeypatch.setattr(lines, "LONG", long)
    monkeypatch.setattr(lines, "MAX_BROADCAST_ROWS", most)  # 0: candidates are joined by shuffle
    random.seed(10)
    words = [f"w{i}" for i in range(12)]
    pool = [[random.choice(words) for _ in range(random.choice([1, 3, 5, 6, 7, 9, 300]))] for _ in range(25)]
    rows = []
    for i in range(60):
        picked = []
        for _ in range(random.randint(1, 5)):
            line = list(random.choice(pool))
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                at = random.randrange(len(line) + 1)
                line[at : at + random.choice([0, 1])] = random.choice([[], [random.choice(words)]])
            picked.append(random.choice(["", " ", "\t"]) + " ".join(line))
        rows.append((i, "\n".join(picked), "en", "s", 1, None))
    df = documents(spark, rows)
    found = {r.doc_id: set(r.dropped_places or []) for r in lines.dedup_lines(df).collect()}
    want = brute_lines([(r[0], r[1]) for r in rows])
    assert found == {i: want.get(i, set()) for i in range(60)}
    for r in lines.dedup_lines(df).collect():
        source = rows[r.doc_id][1].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(source) if i not in want.get(r.doc_id, set()))


def test_line_edge_cases(spark):
    df = documents(spark)
    report = {(r.doc_id, r.n_lines, r.n_dropped) for r in lines.line_report(df).collect()}
    assert (1, 0, 0) in report and (2, 1, 0) in report and (4, 1, 0) in report
    kept = lines.keep_new_lines(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    copies = documents(spark, [(i, "one line of words that repeats\nown line number %s here it is %s" % (i * 7, i), "en", "s", 1, None) for i in range(30)] + [(50, "one line of words that repeats", "en", "s", 1, None)])
    found = {r.doc_id: r.text for r in lines.keep_new_lines(copies).collect()}
    assert 50 not in found and found[0].startswith("one line") and not found[1].startswith("one line")
    assert lines.line_report(df.limit(0)).count() == 0


def test_long_text_of_repeated_lines(spark):
    repeated = documents(spark, [(1, "the same line again\n" * 200_000 + "the end", "en", "s", 1, None)])
    began = time.time()
    (row,) = lines.line_report(repeated).collect()
    assert (row.n_lines, row.n_dropped, row.text) == (200_001, 199_999, "the same line again\nthe end")
    assert time.time() - began < 60


@pytest.mark.parametrize("gone", [[], [0], [4], [0, 1], [1, 3], [0, 1, 2, 3, 4]])
def test_places_are_cut_out(spark, gone):
    df = spark.createDataFrame([("a\n\nc\nd\ne", gone)], "text string, gone array<int>").select(lines.without_places(F.col("text"), F.col("gone")).alias("t"))
    assert df.first().t == "\n".join(x for i, x in enumerate(["a", "", "c", "d", "e"]) if i not in gone)


def test_verification_on_words(spark):
    rows = [("a b c", "a x c"), ("a b c", "b c"), ("a b c", "a b c d"), ("a b c", "c b a"), ("a b", "a b"), ("a b c d", "a c b d"), ("x a b", "a b x")]
    df = spark.createDataFrame(rows, "x string, y string").select(lines._within_one(F.split("x", " "), F.split("y", " ")).alias("r"))
    assert [r.r for r in df.collect()] == [within_one(x.split(), y.split()) for x, y in rows]

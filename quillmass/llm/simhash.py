"""SimHash near-duplicates (operator 5): generalised pigeonhole over correlated bits.

Fingerprints: 64 bits from the XXH64 of word shingles. Two documents link if their fingerprints differ in at most
``reach`` bits; a component is what links connect.

The search runs on distinct fingerprints. Bits are grouped into partitions, correlated ones together. By the
generalised pigeonhole principle two fingerprints within ``reach`` bits agree within t_i bits on some partition i,
for any thresholds t_i with sum reach - partitions + 1 (-1: the partition is not probed). Dynamic programming
allocates unequal thresholds so that the estimated probes and candidates are fewest; the number of partitions is
chosen alike. A probe key is a partition's bits with t_i of them masked out, for every choice of these.

A bucket of over ``MAX_BUCKET`` fingerprints is not paired up. Its members go through an exact way of bounded
group size instead: each emits itself and its 64 one-bit neighbours; fingerprints within two bits share one of
these, and at most 65 fingerprints share the same. So no group is ever paired up in full, and no link is lost.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows link; a component's id is
the smallest id in it (nulls aside; null if it has only such).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, stored, text_or_empty

BITS = 64
MAX_BUCKET = 64
#: Rows of three longs are broadcast up to this number, and joined by shuffle beyond it.
MAX_BROADCAST_ROWS = 250_000
#: Edges (two longs) that one task takes together; more of them go by rounds of joins.
MAX_TASK_EDGES = 250_000
#: A probe's cost against that of verifying one candidate, and of one key of the exact way.
PROBE_COST = 2.0


def _shingles(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; none for a blank text."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    w = text.lower().split()  # bytes: lowers A-Z only, splits at blanks and 9 to 13 only
    if not w:
        return np.zeros(0, "<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    return np.fromiter((hashed(s, 42) for s in shingles), dtype="<u8", count=max(1, len(w) - words + 1))


def _majority(h: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        counts += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text: a bit is set if over half of the shingles' hashes have it."""
    return _majority(_shingles(text, words))


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (a hash of the text) and f (the fingerprint as a signed long) for every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            f = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], names=["doc_id", "text_key", "f"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, text_key long, f long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of set bits, and correlations of bits, over all of them."""

    def moments(batches):
        import pyarrow as pa

        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            f = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype("<i8")
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(f)
            both += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([n, *both[i, j]], pa.int64())], names=["i", "j", "n"])

    cells = distinct.select("f").mapInArrow(moments, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    found = {(r.i, r.j): r.n for r in cells}
    n = found.get((-1, -1), 0)
    both = np.zeros((BITS, BITS))
    for (i, j), x in found.items():
        if i >= 0:
            both[i, j] = both[j, i] = x
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, p, (both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, partitions: int) -> list[list[int]]:
    """Partitions of equal size: each grows by the bit that correlates most with those it has."""
    left, strength = set(range(BITS)), np.abs(correlation)
    out = []
    for k in range(partitions):
        size = BITS // partitions + (k < BITS % partitions)
        rest = sorted(left)
        first = max(rest, key=lambda b: (strength[b, rest].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            b = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for by_threshold in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in by_threshold.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(group: list[int], t: int) -> list[int]:
    """The bits that a key keeps, for every choice of t masked ones."""
    whole = sum(1 << b for b in group)
    return [whole & ~sum(1 << b for b in out) for out in combinations(group, t)]


def plan(distinct: DataFrame, reach: int = 2) -> list[int]:
    """The masks of the probe keys: partitions, thresholds and masked bits from counts over all fingerprints."""
    n, p, correlation = bit_statistics(distinct)
    choices = {m: group_bits(correlation, m) for m in range(2, reach + 3)}
    masks = [(m, i, sum(1 << b for b in g)) for m, groups in choices.items() for i, g in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("f").bitwiseAND(F.lit(_signed(mask))).alias("v")) for k, (_, _, mask) in enumerate(masks)]))
    sizes = distinct.select(keys.alias("key")).select("key.*").groupBy("k", "v").count()
    # candidates of exact matches; large buckets take the exact way, which is linear
    pairs = F.least(F.col("count") * (F.col("count") - 1) / 2, F.col("count") * (BITS + 1) * PROBE_COST)
    collisions = {r.k: r.c for r in sizes.groupBy("k").agg(F.sum(pairs.cast("double")).alias("c")).collect()}
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)  # that two differ in a bit, against that they agree
    best = (float("inf"), [])
    for m, groups in choices.items():
        costs = []
        for i, g in enumerate(groups):
            exact = collisions.get(next(k for k, x in enumerate(masks) if x[:2] == (m, i)), 0.0)
            by = {-1: 0.0}
            for t in range(reach + 1):
                ways = len(list(combinations(g, t)))
                # a key that masks t bits meets all that agree on the others
                by[t] = PROBE_COST * ways * n + exact * sum(np.prod(1 + odds[list(out)]) for out in combinations(g, t))
            costs.append(by)
        cost, chosen = allocate(costs, reach - m + 1)
        if cost < best[0]:
            best = (cost, [mask for g, t in zip(groups, chosen, strict=True) if t >= 0 for mask in _masks(g, t)])
    return best[1] if n else []


def links(distinct: DataFrame, reach: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a < b: pairs of different fingerprints within ``reach`` bits that connect all that are linked.

    Pairs within small buckets are complete; of those that only large buckets show, each fingerprint of a shared
    neighbour is linked to the smallest one there, which is within ``reach`` of it.
    """
    if not 0 <= reach <= 2:
        raise ValueError("the exact way for large buckets covers up to two bits")
    spark = distinct.sparkSession
    masks = plan(distinct, reach)
    if not masks or not reach:
        return spark.createDataFrame([], "a long, b long")
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)]))
    probes = distinct.select("f", keys.alias("key")).select("f", "key.k", "key.v")
    sizes = cut(probes.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1"))
    small = sizes.filter(F.col("n") <= max_bucket).select("k", "v")
    left = probes.join(small, ["k", "v"], "left_semi")
    pairs = left.withColumnRenamed("f", "a").join(left.withColumnRenamed("f", "b"), ["k", "v"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)).select("a", "b")
    large = probes.join(sizes.filter(F.col("n") > max_bucket).select("k", "v"), ["k", "v"], "left_semi").select("f").distinct()
    near = [F.col("f")] + [F.col("f").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]
    shared = large.select("f", F.explode(F.array(*near)).alias("spot")).groupBy("spot").agg(F.array_sort(F.collect_list("f")).alias("fs")).filter(F.size("fs") > 1)
    stars = shared.select(F.element_at("fs", 1).alias("a"), F.explode(F.slice("fs", 2, BITS + 1)).alias("b"))
    stars = stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)  # verify; with reach 1, spots show more
    if reach == 1:
        every = shared.select(F.col("fs"), F.explode("fs").alias("a")).select("a", F.explode("fs").alias("b"))
        stars = every.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach))
    return pairs.unionByName(stars).distinct()


def _united(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches, by union and find over all edges in one task."""

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                x, y = sorted((top(a), top(b)))
                up[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches.

    Up to ``MAX_TASK_EDGES`` edges are united in one task: rounds of joins would cost more in tasks and small files than
    in edges. More go by FastSV: in every round a node takes the smallest grandparent among its neighbours, its parent
    is hooked to that too, and parents are followed one step. So trees merge by their roots, and the rounds grow with
    the logarithm of a component's size, not with its diameter; they go on until nothing changes. Groups are only ever
    reduced to a minimum.
    """
    edges = cut(edges.select("a", "b"))
    if edges.count() <= MAX_TASK_EDGES:
        return cut(_united(edges))
    both = cut(edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))))
    nodes = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("up")).select("node", "up", F.col("node").alias("top")))
    while True:
        heard = both.join(nodes.select(F.col("node").alias("other"), F.col("top").alias("offer")), "other").groupBy("node").agg(F.min("offer").alias("offer"))
        via = cut(nodes.join(heard, "node", "left").select("node", "up", F.col("top").alias("was"), F.least("up", "top", "offer").alias("via")))
        hooks = via.groupBy(F.col("up").alias("node")).agg(F.min("via").alias("hook"))
        hooked = cut(via.join(hooks, "node", "left").select("node", "was", F.least("via", "hook").alias("up")))
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        found = cut(hooked.join(above, "up").select("node", "up", "was", "top"))
        if found.filter("top <> was OR up <> top").isEmpty():
            return found.select("node", F.col("up").alias("root"))
        nodes = found.select("node", "up", "top")


def _classes(found: DataFrame, reach: int) -> DataFrame:
    """f, root: the smallest fingerprint that each distinct fingerprint reaches."""
    distinct = cut(found.select("f").distinct())
    roots = components(links(distinct, reach))
    return cut(distinct.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", F.coalesce("root", "f").alias("root")))


def near_duplicates(documents: DataFrame, words: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    found = cut(fingerprints(documents, words))
    classes = _classes(found, reach)
    least = found.groupBy("f").agg(F.min("doc_id").alias("least"))
    smallest = cut(classes.join(least, "f").groupBy("root").agg(F.min("least").alias("component_id")))
    by_fingerprint = cut(classes.join(smallest, "root").select("f", "component_id"))
    shown = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
    return found.join(by_fingerprint, "f").select("doc_id", shown, "component_id")


def _distinct(h: np.ndarray) -> np.ndarray:
    return np.unique(h.view(np.int64)) if len(h) else np.zeros(1, np.int64)


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, which stand for its set of shingles. A blank text has one, 0."""
    return _distinct(_shingles(text, words))


def _set_key(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 43)).view(np.int64))


def _as_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))


def common_shingles(documents: DataFrame, words: int, share: int = 16, least: int = 3, most: int = 1_000_000) -> np.ndarray:
    """Hashes (at most ``most``, 8 bytes each) of shingles that stand in many texts, as far as a part of the texts shows them.

    They only order prefixes, so that these hold few of them: any order gives the same links.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shingle_hashes(t, words) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["h"])

    part = documents.select(text_or_empty().alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counts = part.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= least)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()], np.int64))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least 512 and two for each shingle; each is the parity of the shingles that fall on it."""
    bits = max(512, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount(hashes & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<i8")


def prefixes(documents: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """doc_id, text_key, f (a hash of the set of shingles), n (its size), s (its fingerprint), odd (a sketch) and its prefix, for every row.

    Sets of similarity 4/5 or more share at least 4/5 of the larger one, so in any one order of all shingles the first
    n - ceil(4n/5) + 1 of each have one in common. The order puts common shingles last.
    """
    spread = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        last = spread.value
        for batch in batches:
            f, n, s, first, odd = [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                every = _shingles(t, words)
                s.append(_majority(every))
                h = _distinct(every)
                at = np.searchsorted(last, h)
                late = (last[np.minimum(at, len(last) - 1)] == h) if len(last) else np.zeros(len(h), bool)
                f.append(_set_key(h))
                n.append(len(h))
                odd.append(_sketch(h))
                first.append(np.concatenate([h[~late], h[late]])[: len(h) - (4 * len(h) + 4) // 5 + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(s, np.uint64).view(np.int64)), pa.array(odd, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "text_key", "f", "n", "s", "odd", "prefix"])

    return _as_texts(documents).mapInArrow(run, "doc_id long, text_key long, f long, n int, s long, odd array<long>, prefix array<long>")


def _sets(documents: DataFrame, found: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """f and hashes (the whole set) of the needed f, from one text of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = [shingle_hashes(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.list_(pa.int64()))], names=["f", "hashes"])

    one = cut(found.join(needed, "f", "left_semi").groupBy("f").agg(F.min(F.struct("text_key", "doc_id")).alias("one")).select("f", "one.*"))
    if one.count() <= MAX_BROADCAST_ROWS:  # three longs each; then no text is shuffled
        one = F.broadcast(one)
    texts = _as_texts(documents).alias("t").join(one.alias("o"), (F.col("t.text_key") == F.col("o.text_key")) & F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")))
    return cut(texts.select("f", "text").mapInArrow(run, "f long, hashes array<long>").dropDuplicates(["f"]))


def _alike(x: str, y: str) -> Column:
    """In how many bits two sketches differ; one of twice the bits is folded first. Their sets differ in at least as many."""

    def folded(sketch: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(sketch) > half, F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(sketch))

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)


def _ends(pairs: DataFrame, *names: str) -> DataFrame:
    """f: what stands in any of these columns, from one reading of them."""
    return pairs.select(F.explode(F.array(*names)).alias("f")).distinct()


def _verified(pairs: DataFrame, documents: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """a, b: those pairs (a, b, na, nb) whose sets have a similarity of 4/5 or more.

    Such sets differ in at most a ninth of the sum of their sizes, so the sketches rule most others out; the rest is
    compared whole.
    """
    pairs = cut(pairs)
    small = cut(found.select("f", "odd").join(_ends(pairs, "a", "b"), "f", "left_semi").dropDuplicates(["f"]))
    near = pairs.join(small.toDF("a", "x"), "a").join(small.toDF("b", "y"), "b")
    near = cut(near.filter(_alike("x", "y") * 9 <= F.col("na") + F.col("nb")).select("a", "b"))
    if near.isEmpty():
        return near
    sets = _sets(documents, found, _ends(near, "a", "b"), words)
    both = near.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * 5 >= (F.size("x") + F.size("y") - common) * 4).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with the smaller set hash first."""
    turned = F.col("a") > F.col("b")
    return pairs.select(*[F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))])


def _sized(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a similarity of 4/5."""
    return pairs.filter((F.col("na") * 5 >= F.col("nb") * 4) & (F.col("nb") * 5 >= F.col("na") * 4))


def _differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, f, n, similar, probe: each set's difference from its hub, as much of it as links can show in.

    Let set A differ from the hub in d(A) shingles. A and B differ in d(A) + d(B) - 2s, where their differences share s.
    A link means at most (n(A) + n(B)) / 9. If B is not linked to the hub, d(B) > (n(B) + n(hub)) / 9, so a link of the
    two needs s > (d(A) + (n(hub) - n(A)) / 9) / 2; and, as s <= d(A) and n(A) <= 5/4 n(B), it needs s >= d(B) - n(B) / 4.
    Hence the two share one of the first shingles of their differences in any one order: of as many as that leaves for
    A, which is linked to the hub, and for B, which is not. Shingles that the hub lacks come first; few sets have them.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            similar, probe = [], []
            given = zip(batch["n"].to_pylist(), batch["nh"].to_pylist(), batch["x"], batch["y"], strict=True)
            for n, nh, x, y in given:
                x, y = x.values.to_numpy(), y.values.to_numpy()
                own, lacked = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                d = len(own) + len(lacked)
                similar.append(9 * d <= n + nh)
                most = d - (9 * d + nh - n) // 18 if similar[-1] else min(d, n // 4 + 1)
                probe.append(np.concatenate([own, lacked])[:most])
            yield pa.RecordBatch.from_arrays([batch["hub"], batch["f"], batch["n"], pa.array(similar, pa.bool_()), pa.array(probe, pa.list_(pa.int64()))], names=["hub", "f", "n", "similar", "probe"])

    both = rows.join(sets.toDF("f", "x"), "f").join(sets.toDF("hub", "y"), "hub").select("hub", "f", "n", "nh", "x", "y")
    return cut(both.mapInArrow(run, "hub long, f long, n int, similar boolean, probe array<long>"))


def _links_of_large(large: DataFrame, documents: DataFrame, found: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and pairs to compare (a, b, na, nb), which together connect what the large buckets (key, f, n) link.

    A bucket's hub is the member that stands in most large buckets, and all members are compared with it. Jaccard
    distance is a metric: a set over 0.4 from the hub has no link to one within 0.2 of it, which sketches show at once.
    Sets between these meet those that are linked to the hub by what they differ from it in. So buckets of copies of
    one text are never paired up; sets that are not linked to their hub are paired up among themselves, once for a hub.
    """
    degree = large.groupBy("f").agg(F.count("*").alias("degree"))
    first = F.max_by(F.struct("f", "n"), F.struct("degree", "f")).alias("h")
    hubs = large.join(degree, "f").groupBy("key").agg(first).select("key", F.col("h.f").alias("hub"), F.col("h.n").alias("nh"))
    rows = cut(large.join(hubs, "key").filter("f <> hub").select("hub", "nh", "f", "n").distinct())
    sketches = cut(found.select("f", "odd").join(_ends(rows, "f", "hub"), "f", "left_semi").dropDuplicates(["f"]))
    both = rows.join(sketches.toDF("f", "x"), "f").join(sketches.toDF("hub", "y"), "hub")
    near = cut(both.filter(_alike("x", "y") * 4 <= F.col("n") + F.col("nh")).select("hub", "nh", "f", "n"))
    deltas = _differences(near, _sets(documents, found, _ends(near, "f", "hub"), words))
    starred = cut(deltas.filter("similar").select(F.col("hub").alias("a"), F.col("f").alias("b")))
    side = lambda similar, f, n: deltas.filter(F.col("similar") == similar).select("hub", F.col("f").alias(f), F.col("n").alias(n), F.explode("probe").alias("t"))
    pairs = side(True, "a", "na").join(side(False, "b", "nb"), ["hub", "t"]).select("a", "b", "na", "nb")
    apart = rows.join(starred.select(F.col("a").alias("hub"), F.col("b").alias("f")), ["hub", "f"], "left_anti")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(1.25))  # sizes of a link differ by one band at most
    left = apart.select("hub", F.col("f").alias("a"), F.col("n").alias("na"), band.alias("band"))
    right = apart.select("hub", F.col("f").alias("b"), F.col("n").alias("nb"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    alike = left.join(right, ["hub", "band"]).filter("a < b").select("a", "b", "na", "nb")
    return starred, _sized(_ordered(pairs).unionByName(alike))


def fingerprint_pairs(found: DataFrame, reach: int = 2) -> DataFrame:
    """a, b, na, nb: sets to compare, by the operator's search over the distinct fingerprints.

    Of the sets of one fingerprint the smallest is compared with the others, and with the smallest of each fingerprint
    within ``reach`` bits; so a fingerprint that many sets share costs one comparison for each.
    """
    sets = cut(found.groupBy("f").agg(F.min("n").alias("n"), F.min("s").alias("s")))
    hubs = cut(sets.groupBy("s").agg(F.min(F.struct("f", "n")).alias("hub")).select("s", "hub.f", "hub.n"))
    inside = sets.toDF("b", "nb", "s").join(hubs.toDF("s", "a", "na"), "s").filter("a <> b").select("a", "b", "na", "nb")
    near = links(hubs.select(F.col("s").alias("f")), reach).toDF("x", "y")
    ends = near.join(hubs.toDF("x", "a", "na"), "x").join(hubs.toDF("y", "b", "nb"), "y")
    return _sized(inside.unionByName(_ordered(ends.select("a", "b", "na", "nb"))))


def similar_classes(documents: DataFrame, found: DataFrame, words: int = 5, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """f, root: the smallest set that each distinct set reaches over similarities of 4/5 or more, exactly.

    First come sets whose fingerprints are linked. Sets of that similarity may differ in more bits than the search
    covers, so an exact one follows: sets that share a shingle of their prefixes, if their sizes allow the similarity;
    buckets of over ``max_bucket`` sets go by the differences from their hubs. All these pairs are compared in one go, each once.
    """
    pairs = fingerprint_pairs(found)
    probes = found.select("f", "n", F.explode("prefix").alias("key"))
    shared = cut(probes.groupBy("key").agg(F.min("f").alias("a"), F.max("f").alias("b")).filter("a < b").select("key"))
    members = cut(probes.join(shared, "key", "left_semi").distinct())
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("c")))
    few = members.join(sizes.filter(F.col("c") <= max_bucket), "key").drop("c")
    pairs = pairs.unionByName(_sized(few.toDF("key", "a", "na").join(few.toDF("key", "b", "nb"), "key").filter("a < b")).select("a", "b", "na", "nb"))
    large = cut(members.join(sizes.filter(F.col("c") > max_bucket).select("key"), "key", "left_semi"))
    starred = None
    if not large.isEmpty():
        starred, more = _links_of_large(large, documents, found, words)
        pairs = pairs.unionByName(more)
    links = _verified(pairs.distinct(), documents, found, words)
    links = links if starred is None else links.unionByName(starred)
    roots = components(links).withColumnRenamed("node", "f")
    return cut(found.select("f").distinct().join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("root")))


def keep_first(documents: DataFrame, words: int = 5) -> DataFrame:
    """One row of each component of texts whose sets of word shingles have a similarity (Jaccard) of 0.8 or more.

    That of the smallest id (then of the smallest text hash) stays, with all its columns. Rows that repeat both id and
    text are one document, of which one row stays. A row without id stays only if its component has none with an id.
    Null texts are no copies of each other; all of them stay. An empty table stays empty; extra columns of any name stay.
    """
    texts = documents.filter(F.col("text").isNotNull())
    found = stored(prefixes(texts, words, common_shingles(texts, words)), "shingles")
    classes = similar_classes(texts, found, words)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    each = cut(found.groupBy("f").agg(F.min(order).alias("first")))
    firsts = each.join(classes, "f").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    repeats = found.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.count("*").alias("rows"))
    names = kept_id, kept_key, kept_rows = fresh(documents.columns, "kept_id", "kept_key", "kept_rows")
    firsts = cut(firsts.join(repeats, firsts["id"].eqNullSafe(repeats["id"]) & (firsts["key"] == repeats["key"])).select(firsts["id"], firsts["key"], "rows").toDF(*names))
    chosen = texts.join(firsts, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_key)))
    once = chosen.filter(F.col(kept_rows) == 1).select(*documents.columns)
    more = chosen.filter(F.col(kept_rows) > 1).dropDuplicates([kept_id, kept_key]).select(*documents.columns)
    return once.unionByName(more).unionByName(documents.filter(F.col("text").isNull()))

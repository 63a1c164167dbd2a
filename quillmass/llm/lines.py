"""Line dedup (operator 6), DataFrame functions only: a deletion-neighbourhood join over the words of lines.

A line (between line ends, outer blanks trimmed, not blank) is dropped if an earlier line of the corpus equals it
or, where both have at least ``min_words`` words, lies within one word edit (a word inserted, deleted or replaced).
Earlier means a smaller document id (null ids last), then text hash, then place in the text.

Equal lines meet by a 128-bit hash. For the rest every line emits its variants with one word deleted as hashed
keys: variants that equal with the same place deleted are one replacement apart, a variant that equals a whole
line is one insertion apart. Such buckets are stars, so each member is compared with the earliest one alone, and
no bucket is paired up. Candidates are verified on the words. Variants are emitted only by lines that share their
first or last half with another line: of two lines within one edit, one half is the same, so none is lost.

An edit is one in five words or more: shorter lines go only if equal, so that "a b" does not drop "a c".

Repeated rows (same id and text) are treated as one document and all get its result. Null texts stay null. Ids are
read as longs (others count as null). Ties cannot occur: equal lines of one document differ in their place. An
empty table gives an empty one; extra columns stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, stored

#: Lines of more words take the windowed way to their variants, whose cost stays linear in the words. Up to here the
#: running arrays of a line copy at most half a million numbers, which is cheaper than a shuffle of its words.
LONG = 1024
#: Candidate lines (two hashes and a place each) are broadcast up to this number, and joined by shuffle beyond it.
MAX_BROADCAST_ROWS = 250_000


def _at(doc: str, key: str, place: str) -> Column:
    """A line's place in the corpus order."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(key).alias("key"), F.col(place).alias("place"))


def _lines(documents: DataFrame) -> DataFrame:
    """doc, key, place, line, a, b (two hashes of the line) of every line that is not blank."""
    texts = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    lines = texts.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    lines = lines.select("doc", "key", "place", F.btrim("raw", F.lit(" \t\r")).alias("line")).filter(F.col("line") != "")
    return lines.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), "line"))


def _half_keys(words: Column, n: Column, min_words: int) -> list[Column]:
    """Hashes of the first and last half, as the shorter and as the longer line of a pair; null where the line is too short."""

    def of(m: Column, least: int) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        # the last m - half words, counted from the end, are the same place in both lines
        first, last = F.xxhash64(F.lit(0), m, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(1), m, F.slice(words, half - m, m - half))
        return [F.when(n >= least, first), F.when(n >= least, last)]

    return [*of(n, min_words), *of(n - 1, min_words + 1)]


def _short_variants(lines: DataFrame) -> DataFrame:
    """The variant keys of lines of up to LONG words, from running exclusive-ors kept in arrays."""
    zero = F.array(F.lit(0).cast("long"))

    def running(column: str) -> Column:
        return F.aggregate(column, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))

    hashed = lines.withColumn("here", F.transform("words", lambda w, j: F.xxhash64(w, j))).withColumn("moved", F.transform("words", lambda w, j: F.xxhash64(w, j - 1)))
    sums = hashed.withColumn("before", running("here")).withColumn("through", running("moved"))
    # the words before the deleted one stay in place, those behind it move up by one
    rest = F.col("before")[F.col("i")].bitwiseXOR(F.element_at("through", -1)).bitwiseXOR(F.col("through")[F.col("i") + 1])
    each = sums.select("a", "b", "n", "whole", "before", "through", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select("a", "b", "n", "i", rest.alias("variant"))


def _long_variants(lines: DataFrame) -> DataFrame:
    """The same keys by windows over exploded words, for lines of any length."""
    words = lines.select("a", "b", "n", F.posexplode("words").alias("i", "w")).withColumn("here", F.xxhash64("w", "i")).withColumn("moved", F.xxhash64("w", F.col("i") - 1))
    line = Window.partitionBy("a", "b")
    up = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("here").over(up).bitwiseXOR(F.col("here"))
    behind = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(up))
    return words.select("a", "b", "n", "i", before.bitwiseXOR(behind).alias("variant"))


def _within_one(x: Column, y: Column) -> Column:
    """Whether two lists of words are within one edit: exact, on the words."""

    def shortened(longer: Column, shorter: Column) -> Column:
        # the first place where they differ is the one to delete
        place = F.coalesce(F.array_position(F.zip_with(F.slice(longer, 1, F.size(shorter)), shorter, lambda p, q: p != q), True), F.lit(0)).cast("int")
        place = F.when(place == 0, F.size(longer)).otherwise(place)
        return F.concat(F.slice(longer, F.lit(1), place - 1), F.slice(longer, place + 1, F.size(longer))) == shorter

    return (
        F.when(F.size(x) == F.size(y), F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d)) <= 1)
        .when(F.size(x) == F.size(y) + 1, shortened(x, y))
        .when(F.size(y) == F.size(x) + 1, shortened(y, x))
        .otherwise(F.lit(False))
    )


def _candidates(distinct: DataFrame, min_words: int) -> DataFrame:
    """a, b, first, n of the distinct lines that share a half with another: all that can have one within an edit."""
    halves = distinct.filter(F.col("n") >= min_words).select("a", F.explode(F.array("h1", "h2", "h3", "h4")).alias("half")).filter("half IS NOT NULL")
    shared = cut(halves.groupBy("half").agg(F.count("*").alias("sharing")).filter("sharing > 1").select("half"))
    sharing = cut(halves.join(shared, "half", "left_semi").select("a").distinct())
    return cut(distinct.select("a", "b", "first", "n").join(sharing, "a", "left_semi"))


def similar_lines(documents: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """a, b: the distinct lines that have an earlier line within one edit. ``distinct``: a, b, first, n, h1 to h4."""
    candidates = _candidates(distinct, min_words)
    # the words of candidates come from a second scan, at their first place; no other line's text is moved
    wanted = candidates if candidates.count() > MAX_BROADCAST_ROWS else F.broadcast(candidates)
    lines = _lines(documents)
    found = lines.join(wanted, ["a", "b"]).filter(F.col("first") == _at("doc", "key", "place"))
    left = found.select("a", "b", "first", "n", F.split("line", " ").alias("words")).dropDuplicates(["a", "b"])
    whole = F.aggregate(F.transform("words", lambda w, j: F.xxhash64(w, j)), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))
    left = cut(left.withColumn("whole", whole))
    emitted = _short_variants(left.filter(F.col("n") <= LONG)).unionByName(_long_variants(left.filter(F.col("n") > LONG)))
    # roles: 0 a line with one place replaced, 1 a longer line with one word deleted, 2 a whole line
    as_replaced = F.xxhash64(F.lit("replace"), "n", "i", "variant")
    as_longer = F.xxhash64(F.lit("insert"), F.col("n") - 1, "variant")
    keyed = emitted.select("a", "b", F.explode(F.array(F.struct(as_replaced.alias("bucket"), F.lit(0).alias("role")), F.struct(as_longer.alias("bucket"), F.lit(1).alias("role")))).alias("k")).select("a", "b", "k.*")
    wholes = left.select("a", "b", F.xxhash64(F.lit("insert"), "n", "whole").alias("bucket"), F.lit(2).alias("role"))
    keyed = keyed.unionByName(wholes)
    # buckets that can link: two lines with the same place replaced, or a whole line and a longer one
    roles = keyed.groupBy("bucket").agg(F.count_if(F.col("role") == 0).alias("replaced"), F.count_if(F.col("role") == 1).alias("longer"), F.count_if(F.col("role") == 2).alias("wholes"))
    linking = cut(roles.filter("replaced > 1 OR (longer > 0 AND wholes > 0)").select("bucket"))
    members = cut(keyed.join(linking, "bucket", "left_semi").distinct().join(left.select("a", "b", "first"), ["a", "b"]))
    # a longer line is compared with the whole one, and that with the earliest longer one
    against = F.when(F.col("role") == 1, 2).when(F.col("role") == 2, 1).otherwise(0)
    earliest = cut(members.groupBy("bucket", "role").agg(F.min(F.struct("first", "a", "b")).alias("e")))
    earliest = earliest.select(F.col("bucket").alias("bucket2"), F.col("role").alias("role2"), F.col("e.first").alias("first2"), F.col("e.a").alias("a2"), F.col("e.b").alias("b2"))
    pairs = members.withColumn("against", against).join(earliest, (F.col("bucket") == F.col("bucket2")) & (F.col("against") == F.col("role2"))).filter(F.col("first2") < F.col("first"))
    pairs = pairs.select("a", "b", "a2", "b2").distinct()
    texts = left.select("a", "b", "words")
    other = left.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("words2"))
    verified = pairs.join(texts, ["a", "b"]).join(other, ["a2", "b2"]).filter(_within_one(F.col("words"), F.col("words2")))
    return verified.select("a", "b").distinct()


def dropped_lines(documents: DataFrame, min_words: int = 5, label: str = "lines") -> DataFrame:
    """doc, key, places: the line numbers (from 0) that go, for each document that loses any.

    Lines move as hashes and places only, in one shuffle for equal lines and one for those that go.
    """
    words = F.split("line", " ")
    hashed = _lines(documents).withColumn("words", words).withColumn("n", F.size("words"))
    halves = {f"h{k}": c for k, c in enumerate(_half_keys(F.col("words"), F.col("n"), min_words), 1)}
    narrow = hashed.select("a", "b", _at("doc", "key", "place").alias("at"), "n", *[c.alias(h) for h, c in halves.items()])
    firsts = narrow.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *halves)])
    distinct = stored(firsts, label)
    similar = cut(similar_lines(documents, distinct, min_words)).withColumn("similar", F.lit(True))
    touched = distinct.select("a", "b", "first", "copies").join(similar, ["a", "b"], "left").filter("copies > 1 OR similar").select("a", "b", "first", F.coalesce("similar", F.lit(False)).alias("similar"))
    touched = cut(touched)
    places = _lines(documents).select("doc", "key", "place", "a", "b").join(touched, ["a", "b"]).filter(F.col("similar") | (F.col("first") < _at("doc", "key", "place")))
    return places.groupBy("doc", "key").agg(F.sort_array(F.collect_set("place")).alias("places"))  # at most a document's lines


def without_places(text: Column, places: Column) -> Column:
    """The text without the lines at ``places`` (sorted, from 0): what stands between two of them is one slice.

    The lists pass through lambda variables, so they are computed once, and slices do not overlap: the cost is linear.
    """

    def cleaned(x: Column) -> Column:
        lines, gone = x["lines"], x["gone"]
        starts = F.concat(F.array(F.lit(1)), F.transform(gone, lambda p: p + 2))
        ends = F.concat(gone, F.array(F.size(lines)))  # as places from 0, these are the numbers from 1 of the lines before
        between = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.slice(lines, g["s"], g["e"] - g["s"] + 1))
        return F.array_join(F.flatten(between), "\n")

    return F.element_at(F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), places.alias("gone"))), cleaned), 1)


def dedup_lines(documents: DataFrame, min_words: int = 5, label: str = "lines", places: str = "dropped_places") -> DataFrame:
    """All rows and columns, text without its dropped lines, and ``places`` (the dropped line numbers, null for none).

    ``documents`` must not have a column named ``places``; every other name is free.
    """
    doc, key = fresh([*documents.columns, places], "doc", "key")
    gone = dropped_lines(documents, min_words, label).toDF(doc, key, places)
    joined = documents.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(places).isNotNull(), without_places(F.col("text"), F.col(places))).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*documents.columns, places)


def line_report(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without dropped lines) for every row; null texts have no lines."""
    marked = dedup_lines(documents.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")), min_words)
    return marked.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped_places"), F.lit(0)).alias("n_dropped"), "text")


def keep_new_lines(documents: DataFrame, min_words: int = 5) -> DataFrame:
    """The same columns; documents whose every line was dropped go, all others stay (blank and null ones too)."""
    (places,) = fresh(documents.columns, "places")
    marked = dedup_lines(documents, min_words, places=places)
    return marked.filter(F.col(places).isNull() | (F.btrim("text", F.lit(" \t\r\n")) != "")).select(*documents.columns)

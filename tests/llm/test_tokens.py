"""Token counts, the automaton and packing against the tokenizers library."""

import random
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillmass.llm import bpe, packing, tokens  # noqa: E402

from .helpers import documents  # noqa: E402

PARTS = list("aaabbe  \n\t '’sTlxzé \u0085\x1c\x1f　İΣſKß😀ñ漢字0123½!?.-_") + ["<|endoftext|>", "<|startoftext|>", "'re", "ing", "the", "́", "\xa0", "‍", "ﬁ", " the", "\n\n", "hehehe", "anananan"]


@pytest.fixture(scope="module")
def fuzz():
    random.seed(5)
    return ["".join(random.choices(PARTS, k=random.randint(0, 30))) for _ in range(2500)] + ["ha" * n for n in range(25)] + ["a" * n for n in range(40)]


def test_counts_equal_the_library(fuzz):
    path = P.path("byte_bpe_50k.json")
    vocabulary, library = bpe.Vocabulary(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    counter, encoder = bpe.MergeCounter(vocabulary), bpe.ChunkEncoder(vocabulary, bpe.compiled_encoder(vocabulary))
    for text in fuzz:
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(ids), repr(text)
        assert [int.from_bytes(encoder.encode_bytes(text)[i : i + 4], "little") for i in range(0, 4 * len(ids), 4)] == ids


def test_encoder_keeps_few_chunks():
    """A worker's caches stay small beside what other stages of a pipeline have taken; what was dropped is encoded again."""
    vocabulary = bpe.Vocabulary(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    encoder = bpe.ChunkEncoder(vocabulary, bpe.compiled_encoder(vocabulary))
    words = [f"w{i:x}" for i in range(200_000)]
    first = encoder.encode_bytes(" ".join(words[:100]))
    encoder.encode_bytes(" ".join(words))
    assert sum(len(c) + len(c.before) for c in (encoder.first, encoder.later)) <= 160_000
    assert encoder.encode_bytes(" ".join(words[:100])) == first


def test_automaton_equals_the_library(fuzz):
    path = P.path("word_bpe_49k.json")
    automaton, library = bpe.Automaton(bpe.Vocabulary(open(path, encoding="utf-8").read())), Tokenizer.from_file(path)
    for text in fuzz:
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids, repr(text)
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_a_byte_vocabulary(fuzz):
    """The same construction without word ends."""
    path = P.path("byte_bpe_50k.json")
    vocabulary, library = bpe.Vocabulary(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    automaton = bpe.Automaton(vocabulary)
    for word in {w for t in fuzz for w in automaton.pattern.findall(t) if "<" not in w}:
        assert list(automaton.encode_word(word)) == library.encode(word, add_special_tokens=False).ids, repr(word)


def test_other_files_are_refused():
    import json

    for name, change in (("byte_bpe_50k.json", {"normalizer": {"type": "NFC"}}), ("byte_bpe_50k.json", {"pre_tokenizer": None}), ("word_bpe_49k.json", {"decoder": {"type": "ByteLevel"}})):
        data = json.load(open(P.path(name), encoding="utf-8"))
        assert bpe.style(data) in ("byte", "word")
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(data | change))
    with pytest.raises(ValueError):
        bpe.MergeCounter(bpe.Vocabulary(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()))


def test_query_columns_equal_the_library(spark, tmp_path):
    """Every column of op4, op9 and op10 against the library, on edge cases and fuzzed texts."""
    import hashlib

    from quillmass.llm import queries

    from .helpers import write_tables

    random.seed(15)
    rows = [(100 + i, "".join(random.choices(PARTS + ["word ", "and the "], k=random.randint(0, 700))), "en", "s", 1, None) for i in range(60)]
    df = documents(spark).unionByName(documents(spark, rows))
    folder = write_tables(spark, tmp_path, documents=df)
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    byte, word = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids4 = [(i, t, byte.encode(t, add_special_tokens=False).ids) for i, t in texts]
    want4 = [(i, len(t.encode()), len(x), len(x) > 512) for i, t, x in ids4]
    assert sorted(map(str, want4)) == sorted(str(tuple(r)) for r in queries.op4_token_counts(spark, folder).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want9 = [(i, len(x), sha(" ".join(map(str, x))), sha(word.decode(x, skip_special_tokens=False))) for i, x in ((i, word.encode(t, add_special_tokens=False).ids) for i, t in texts)]
    assert sorted(map(str, want9)) == sorted(str(tuple(r)) for r in queries.op9_bpe_automaton(spark, folder).collect())
    found = queries.op10_best_fit_packing(spark, folder).collect()
    check_packing(found, 2048)
    whole = {}
    for i, _, x in ids4:
        x = [*x, 0]
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x), 2048), len(x)]
        for k in range(len(cuts) - 1):
            part = x[cuts[k] : cuts[k + 1]]
            row = (i, k, cuts[k], len(part), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in part)))
            whole[row] = whole.get(row, 0) + 1
    got = {}
    for r in found:
        row = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[row] = got.get(row, 0) + 1
    assert got == whole
    for query in (queries.op4_token_counts, queries.op9_bpe_automaton, queries.op10_best_fit_packing):
        empty = write_tables(spark, tmp_path / "empty", documents=df.limit(0))
        assert query(spark, empty).count() == 0


def test_columns_on_edge_cases(spark):
    df = documents(spark)
    counts = tokens.count_tokens(df, P.path("byte_bpe_50k.json"))
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and counts.count() == df.count()
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.collect()}
    assert found[1] == found[2] == (0, 0, False) and found[6][2]
    both = {r.doc_id: r for r in tokens.encode_documents(df, P.path("word_bpe_49k.json")).collect()}
    assert both[1].ids == [] and both[1].decoded == "" and both[5].ids
    assert tokens.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    encoded = tokens.encode_documents(df, P.path("word_bpe_49k.json"))
    again = encoded.select("doc_id", tokens.decode(spark, encoded["ids"], P.path("word_bpe_49k.json")).alias("t"))
    assert {r.doc_id: r.t for r in again.collect()} == {i: r.decoded for i, r in both.items()}


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = documents(spark)
    rows = packing.pack_documents(df, path, capacity=64, with_ids=True).collect()
    check_packing(rows, 64)
    by_doc = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and len(r.ids) == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in [(r.doc_id, r.text or "") for r in df.collect()]:
        want = [*library.encode(text, add_special_tokens=False).ids, 0]
        pieces = {r.piece: r for r in by_doc[doc_id]}
        assert [i for k in sorted(pieces) for i in pieces[k].ids] == want
        assert all(p.length == 64 for k, p in pieces.items() if k) and pieces[0].start == 0
    assert packing.pack_documents(df.limit(0), path).count() == 0


@pytest.mark.parametrize("group_rows", [50, 100_000])
def test_bins_stay_near_the_bound(spark, group_rows):
    random.seed(6)
    lengths = [random.choice([random.randint(1, 100), random.randint(30, 60), 34, 51]) for _ in range(900)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE)
    rows = packing.pack(df, capacity=100, group_rows=group_rows).collect()
    assert sorted(r.doc_id for r in rows) == list(range(900))
    assert check_packing(rows, 100) <= packing.bins_needed(lengths, 100) * 1.02 + 2 + 900 // group_rows  # a group may leave one bin unfilled


def test_bounds_and_best_fit():
    assert packing.bins_needed([], 10) == 0 and packing.bins_needed([6] * 5, 10) == 5 and packing.bins_needed([4, 4, 4, 4], 10) == 2
    assert packing.best_fit_decreasing([7, 5, 3, 5], 10) in ([0, 1, 0, 1],)
    random.seed(7)
    for _ in range(50):
        xs = [random.randint(1, 20) for _ in range(30)]
        bins = packing.best_fit_decreasing(xs, 20)
        assert packing.bins_needed(xs, 20) <= len(set(bins)) and max(sum(x for x, b in zip(xs, bins, strict=True) if b == k) for k in set(bins)) <= 20

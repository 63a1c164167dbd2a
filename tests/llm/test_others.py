"""Language identification, URL filters, top-k, secrets and media on small tables and against brute force."""

import base64
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmass.llm import langid, media, queries, secrets, topk, urls

from .helpers import documents, write_tables

# ---- languages


def language_rows(n):
    random.seed(11)
    parts = {"en": "the and of ing th er", "de": "der die und ich ung sch", "fr": "les des eau que é ment"}
    rows = []
    for i in range(n):
        lang = random.choice(list(parts))
        rows.append((i, " ".join(random.choice(parts[lang].split()) + random.choice(parts[lang].split()) for _ in range(random.randint(5, 200))), lang, "s", 1, None))
    return rows


def test_language_accuracy_and_edges(spark, tmp_path):
    df = documents(spark, language_rows(300)).unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    folder = write_tables(spark, tmp_path, documents=df)
    rows = queries.op1_language_id(spark, folder).collect()
    assert len(rows) == df.count()
    truth = {r.doc_id: r.lang for r in df.collect()}
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 300]
    held = [r for r in known if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in known)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1001, 1002, 1003)} == {"und"}


def test_language_without_labels(spark):
    df = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    net = langid.train(df)
    assert net is None and {r.lang_pred for r in langid.identify(df, net).collect()} == {"und"}
    assert langid.keep_identified(df, net).count() == df.count()


def test_training_sample_is_bounded(spark):
    """20 000 equal rows without id, beside few of another language: one row stands for all of them."""
    rows = [(None, "ein und derselbe Satz", "de", "s", 1, None)] * 20_000 + [(i, f"the row number {i} of many words", "en", "s", 1, None) for i in range(500)] + [(7, "un seul", "fr", "s", 1, None)]
    df = documents(spark, rows)
    languages, found = langid.sample_rows(df, langid.Sample(rows=60), 100, "text", "lang", "doc_id")
    counts = {lang: sum(r.lang == lang for r in found) for lang in languages}
    assert counts["de"] == counts["fr"] == 1 and 10 <= counts["en"] <= 20
    net = langid.train(df, langid.Sample(rows=60))
    assert {r.lang_pred for r in langid.identify(df.filter("doc_id = 7"), net).collect()} <= {"de", "en", "fr"}
    assert langid.train(df.limit(0)) is None and langid.identify(df.limit(0), net).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.ByteNet(["a", "b"], langid.Shape(window=12, embedding=3, widths=(2, 3), filters=4))
    for p in net.parameters():
        p[...] = rng.normal(0, 0.5, p.shape)
    windows, labels = rng.integers(1, 256, (5, 12), dtype=np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()
    for p, g in zip(net.parameters(), net.gradients(windows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[at]
        p[at] = keep + 1e-2
        up = loss()
        p[at] = keep - 1e-2
        down = loss()
        p[at] = keep
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=2e-3)


# ---- URLs


URLS = [None, "", "no scheme", "http://EXAMPLE.org", "http://example.org/es/x", "http://sub.example.org/en/17?q#f", "http://notexample.org/en/1", "https://a.com/fr/1", "https://a.com/FR/1", "http://x.com/de/", "http://www.casino-win.example.net/a", "http://a.org?x=/es/", "a://b://c.com/de/x", "http://org/x", "http://com/de/\nx"]


@pytest.mark.parametrize("inline", [True, False])
def test_url_rules(spark, inline):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x")], "page_id long, url string, host string")
    found = [r.asDict() for r in urls.judge(df, queries.RULES, inline=inline).collect()]
    assert len(found) == len(URLS) + 1
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert by_id[0] == by_id[2] == ("", "", None, "allow") and by_id[3] == ("example.org", "", None, "allow")
    assert by_id[4][2:] == ("example.org/es/", "block") and by_id[5][2:] == ("example.org/en/1", "block") and by_id[6][2:] == ("org/", "allow")
    assert by_id[7][2:] == ("com/fr/", "allow") and by_id[8][2:] == (None, "allow") and by_id[9][2:] == ("com/de/", "block")
    assert by_id[10][2:] == (None, "block") and by_id[13][2:] == ("org/", "allow") and by_id[14][2:] == ("com/de/", "block")


@pytest.mark.parametrize("inline", [True, False])
def test_thousands_of_rules_equal_running_every_rule(spark, inline):
    rng = random.Random(12)
    words = queries.FIRST[:12] + queries.SECOND[:12] + ["a", "news", "x1"]
    hosts = [urls.HostRule(rng.choice(["allow", "block"]), f"{rng.choice(words)}.{rng.choice(['com', 'org', 'net'])}/{'/'.join(rng.choices(words, k=rng.randint(0, 2)))}") for _ in range(300)]
    hosts = list({r.rule: r for r in hosts}.values())
    patterns = tuple(urls.PatternRule(rng.choice(["allow", "block", "block"]), s) for s in sorted({rng.choice(["{}-{}.", "/{}/{}/", "/{}/*/{}.", "{}*{}", ".{}/{}"]).format(*rng.choices(words, k=2)) for _ in range(2000)}))
    rules = urls.RuleSet(tuple(hosts), patterns)
    found_urls = [f"https://{rng.choice(['', 'www.', 'a.b.'])}{'-'.join(rng.choices(words, k=rng.randint(1, 2)))}.{rng.choice(['com', 'org', 'net'])}/{'/'.join(rng.choices(words, k=rng.randint(0, 4)))}{rng.choice(['', '/', '.html', '/?q=a-b.'])}" for _ in range(90)] + ["http://a.com/" + "/".join(rng.choices(words, k=2000)), None, ""]
    df = spark.createDataFrame(list(enumerate(found_urls)), "page_id long, url string")
    ordered = rules.ordered()
    for r in urls.judge(df, rules, inline=inline).collect():
        subject = r.host + r.path
        fits = [n for n, rule in enumerate(ordered) if re.search(rule.expression, subject)]
        host = max((n for n in fits if n < len(hosts)), default=None)
        allowed = [n for n in fits if n >= len(hosts) and ordered[n].verdict == "allow"]
        pattern = min(allowed or [n for n in fits if n >= len(hosts)], default=None)
        decided = host if host is not None else pattern
        assert (r.rule, r.verdict, r.method_rule) == (host if host is None else ordered[host].rule, "allow" if decided is None else ordered[decided].verdict, pattern if pattern is None else ordered[pattern].rule)


def test_url_query_on_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, "http://a.net/" + "x/" * 100_000 + "casino/win/"])], "page_id long, url string, verdict string, rule string")
    found = {r.page_id: r for r in queries.op2_url_filters(spark, write_tables(spark, tmp_path, pages=df)).collect()}
    assert len(found) == len(URLS) + 1 and found[len(URLS)].method_rule == "/casino/win/" and found[10].method_rule == "casino-win."
    assert queries.op2_url_filters(spark, write_tables(spark, tmp_path / "empty", pages=df.limit(0))).count() == 0
    assert len(queries.RULES.patterns) > 4000


def test_rules_are_indexed_by_their_rarest_token(spark):
    index = queries.RULES.index()
    ordered = queries.RULES.ordered()
    assert sum(map(len, index.values())) == len(ordered)
    assert all(not t or t in ordered[n].tokens for t, ns in index.items() for n in ns)
    rules = urls.RuleSet((), (urls.PatternRule("block", "*"), urls.PatternRule("allow", "/ok/*/b.")))
    df = spark.createDataFrame([(1, "http://a/ok/zz/b.c"), (2, "http://a/x")], "page_id long, url string")
    for inline in (True, False):
        assert {r.page_id: r.verdict for r in urls.judge(df, rules, inline=inline).collect()} == {1: "allow", 2: "block"}


# ---- top-k


def test_top_k_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (400, 8)) * rng.lognormal(0, 1, (400, 1))
    vectors[50] = vectors[60] = vectors[100]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)] + [(500, None, 1), (600, [1.0, None] + [0.0] * 6, 1), (700, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (200, [float(np.float32(x)) for x in vectors[200]], 2)]
    folder = write_tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    found = {}
    for r in queries.op3_exact_top_k(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert set(found) == {0, 100, 200, 300}
    for q in found:
        own = next(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in fine if i != q)[:10]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]


def brute_top_k(rows, queries, k=10):
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items() if i != q)[:k])] for q in queries}


@pytest.mark.parametrize(("size", "dim", "spread"), [(2e5, 8, 0), (1e4, 6, 1), (1e6, 3, 0)])
def test_top_k_of_large_values_in_many_cells(spark, size, dim, spread):
    rng = np.random.default_rng(5)
    rows = {i: [float(x) for x in rng.uniform(-1, 1, dim) * size * rng.lognormal(0, 1) ** spread] for i in range(300)}
    rows |= {i: [abs(x) for x in rows[i]] for i in (50, 100, 150)}
    rows[250] = rows[100]
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, query_block=8, shard_rows=25, head_rows=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows.items()}
    assert {q: sorted(f) for q, f in found.items()} == brute_top_k(whole, range(0, 300, 10))


def test_top_k_out_of_range(spark):
    for values in ([4e6, 4e6], [1e17, 0.0]):
        df = spark.createDataFrame([(i, [1e7 * v for v in values] if values[0] < 1e10 else values) for i in range(12)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="out of the range of long"):
            topk.top_k(df, F.lit(True)).collect()
    q, c = np.array([[3 << 40, -(3 << 40)]]), np.array([[5 << 40, 5 << 40], [1 << 20, 0]])
    assert topk.products(q, c).tolist() == [[0, 3 << 60]] if (3 << 60) < 1 << 63 else True


def test_top_k_of_one_length_and_many_dimensions(spark):
    rows = [(i, [1.0 if j == i % 4 else 0.0 for j in range(4)]) for i in range(120)] + [(200 + i, [0.5] * (1 + i)) for i in range(30)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, query_block=2, shard_rows=16, head_rows=8).collect()
    found = {q: [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in range(0, 120, 20)}
    assert found == brute_top_k({i: [int(1024 * x) for x in v] for i, v in rows if i < 120}, range(0, 120, 20))
    assert not [r for r in got if r.query_id == 200]  # the only one of its dimension


def test_top_k_prunes_and_takes_few(spark):
    rng = np.random.default_rng(4)
    vectors = np.rint(rng.normal(0, 50, (4000, 16)) * rng.lognormal(0, 1.5, (4000, 1))).astype(np.int64)
    _, turn = np.linalg.eigh(vectors.T.astype(float) @ vectors)
    scan = topk.Scan(np.arange(20), vectors[:20], [(0, turn[:, ::-1])], 10)
    scan.walk(np.arange(4000), vectors)
    assert scan.pairs_computed < 20 * 4000 / 2
    few = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(few, F.col("vec_id") % 100 == 0).collect()) == [(0, 100, 2048 * 1024), (100, 0, 2048 * 1024)]
    assert topk.top_k(few.limit(0), F.lit(True)).count() == 0


# ---- secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)])
    return bytes([tag]) + size + body


KEY = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"*\x86H"), der(0x05)), der(0x04, bytes(range(90)) + bytes(60)))
SSH = (7).to_bytes(4, "big") + b"ssh-rsa" + (40).to_bytes(4, "big") + bytes(range(40))


def test_secrets_confirmed_by_structure():
    token = ".".join([base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("="), "eyJ4IjoxfQ", "c2ln"])
    other = ".".join([base64.urlsafe_b64encode(json.dumps({"no": "HS256"}).encode()).decode().rstrip("="), "eyJ4IjoxfQ", "c2ln"])
    key = base64.b64encode(KEY).decode()
    text = f"é {token} and {other} or {key} hex {KEY.hex()} pem -----BEGIN PRIVATE KEY-----\n{key[:64]}\n{key[64:]}\n-----END PRIVATE KEY----- ssh-rsa {base64.b64encode(SSH).decode()} end"
    kinds = [k for k, _, _ in secrets.scan(text)]
    assert kinds.count("jwt") == 1 and kinds.count("pem") == 1 and kinds.count("sshkey") == 1 and kinds.count("der") >= 2
    broken = base64.b64encode(KEY[:-1]).decode()
    assert not [k for k, _, _ in secrets.scan(f"{broken} M{'a' * 60}") if k == "der"]
    start, end = next((a, b) for k, a, b in secrets.scan(text) if k == "jwt")
    assert text[start:end] == token


def test_keys_after_an_equals_sign():
    der = b"\x30\x2d\x02\x01\x00\x04\x28" + bytes(range(40))
    ssh = b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(range(32))
    values = [(base64.b64encode(der).decode(), "der"), (der.hex(), "der"), (der.hex().upper(), "der"), (base64.b64encode(ssh).decode(), "sshkey")]
    for value, kind in values:
        for before in ("PRIVATE_KEY=", "?a=b&k="):
            text = f"{before}{value}&x"
            assert (kind, len(before), len(before) + len(value)) in secrets.scan(text)
            assert value not in secrets.redacted(text)


def test_base_spans_equal_the_plain_patterns(spark, tmp_path):
    """The base columns of op7 against the given patterns, applied one by one, on random texts of their parts."""
    rng = random.Random(13)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "AKIA", "ABCDEFGH", "0123456789", "abcdef", "/+._-", "\n", "é", "\t", "x"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)]
    folder = write_tables(spark, tmp_path, documents=documents(spark, [(i, t, "en", "s", 1, None) for i, t in enumerate(texts)]))
    for r in queries.op7_secret_scan(spark, folder).collect():
        text = texts[r.doc_id]
        assign = [m.span() for m in re.finditer("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
        access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert (r.n_assign, r.n_access, r.n_hex) == (len(assign), len(access), len(hexes))
        spans = sorted((a, k, b) for k, found in enumerate((assign, access, hexes)) for a, b in found)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
    assert queries.op7_secret_scan(spark, write_tables(spark, tmp_path / "empty", documents=documents(spark).limit(0))).count() == 0


def test_base_secrets(spark, tmp_path):
    texts = ["Password: 'abcdefghijkl' x", "token:secret:abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIAABC", "0123456789abcdef 0123456789abcde", "ſecret=abcdefghijklmnop", "api_key = short", "apikey=0123456789abcdef0"]
    rows = [(i + 10, t, "en", "s", 1, None) for i, t in enumerate(texts)]
    folder = write_tables(spark, tmp_path, documents=documents(spark).unionByName(documents(spark, rows)))
    found = {r.doc_id: r for r in queries.op7_secret_scan(spark, folder).collect()}
    counts = {i: (found[i].n_assign, found[i].n_access, found[i].n_hex) for i in range(10, 17)}
    assert counts == {10: (1, 0, 0), 11: (0, 0, 0), 12: (0, 1, 0), 13: (0, 0, 1), 14: (0, 0, 0), 15: (0, 0, 0), 16: (1, 0, 1)}
    assert found[16].spans == "assign:0:24,hex:7:24" and found[16].base_sha256 == hashlib.sha256(b"assign:0:24,hex:7:24").hexdigest()
    assert found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_redaction(spark):
    assert secrets.redacted("a password=abcdefghijkl b") == "a [SECRET] b" and secrets.redacted("nothing") == "nothing"
    df = documents(spark)
    clean = secrets.redact_secrets(df)
    assert clean.columns == df.columns and sorted(str(r.text) for r in clean.collect()) == sorted(str(r.text) for r in df.collect())


# ---- media


def test_sequences_keep_order_and_captions(spark):
    page = '<html><head><title>t</title></head><body><p>one <b>two</b></p><figure><img src="sha256:ab" alt="x"><figcaption>cap &amp; more</figcaption></figure>tail<img src="http://z" alt="alt"><script>no</script></body>'
    items = media.parse_sequence(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "one two", None, None), (1, "media", None, "ab", "cap & more"), (2, "text", "tail", None, None), (3, "media", "http://z", None, "alt")]
    assert media.parse_sequence(None) == [] and media.parse_sequence("<p>") == []
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    payloads = spark.createDataFrame([("ab", b"bytes")], "digest string, media binary")
    whole = media.assemble(media.resolve(pages, "html", payloads), ["page_id"], F.col("media")).collect()
    assert len(whole) == 1 and [(i.kind, i.payload) for i in whole[0]["items"]] == [("text", None), ("media", b"bytes"), ("text", None), ("media", None)]


def test_real_pages_with_hot_payloads(spark):
    """All pages, each with media after some of its paragraphs, one of them on every page, against the parse on the driver."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").limit(40).collect()
    rows = []
    for n, (page_id, html) in enumerate(pages):
        extra = "".join(f'<figure><img src="sha256:{d}"><figcaption>about {d} &amp; {n}</figcaption></figure><p>after {d}</p>' for d in ("logo", f"d{n % 7}", "unknown"))
        rows.append((page_id, (html or "") + extra, "x", n))
    df = spark.createDataFrame(rows, "page_id long, html string, ref string, salt int")
    payloads = spark.createDataFrame([(d, d.encode()) for d in ["logo", *[f"d{k}" for k in range(7)]]], "digest string, media binary")
    hot = spark.createDataFrame([("logo",)], "digest string")
    for part in (None, hot):
        found = media.assemble(media.resolve(df, "html", payloads, part), ["page_id", "ref", "salt"], F.col("media")).collect()
        assert len(found) == len(rows)
        for r in found:
            page = next(x[1] for x in rows if x[0] == r.page_id)
            want = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parse_sequence(page)]
            assert [tuple(i)[:5] for i in r["items"]] == want and len(want) >= 6
            assert all(i.payload == (i.digest.encode() if i.digest and i.digest != "unknown" else None) for i in r["items"])
    counted = spark.createDataFrame([("a", 5000), ("b", 3), ("c", 4)], "digest string, copies long")
    assert [r.digest for r in media.hot_digests(counted).collect()] == ["a"] and media.hot_digests(counted.limit(0)).count() == 0


def test_media_round_trip(spark, tmp_path):
    df = documents(spark)
    folder = write_tables(spark, tmp_path, documents=df)
    rows = queries.op8_media_columns(spark, folder).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        image = media.to_image(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest())
        assert media.from_image(image)[2] == payload
        means = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(float).mean(axis=0)
        assert r.feature == f"rgb 8x{len(payload) // 24} mean " + " ".join(f"{m:.3f}" for m in means)
        assert (r.position, r.n_items) == (1, 3) and r.caption.startswith(f"{len(data)} bytes")
    values = {}
    for r in rows:
        values.setdefault(texts[r.doc_id], set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in values.values())  # equal texts, equal values
    assert queries.op8_media_columns(spark, write_tables(spark, tmp_path / "empty", documents=df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        media.from_image(b"P6\n8 9\n255\nshort")

"""Periodic runs, repeated windows and the filter audit against brute force and SQL; nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import audit, html, periodic, suffix, webp, windows
from tessera.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
SEED_TEXTS = [None, "", " \t", "a", "a\x0bb", "é " * 40, "x y " * 300 + "z", "a" * 5000, "w " * 3000]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def slow_runs(w, exponent, least):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j, q) for (i, j), q in found.items())


def some_words(rng):
    n, k, w = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4]), []
    while len(w) < n:
        if w and rng.random() < 0.4:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 30)]
        else:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        w, e, least = some_words(rng), rng.choice([2, 3, 4]), rng.choice([2, 6])
        assert periodic.runs(w, e, least) == slow_runs(w, e, least)


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(2)
    for _ in range(500):
        w = some_words(rng)
        at = 0
        for start, size, source in periodic.factors(w):
            assert start == at
            at += size
            if source >= 0:
                assert source < start and w[source : source + size] == w[start:at]
                assert at == len(w) or not any(w[s : s + size + 1] == w[start : at + 1] for s in range(start))
            else:
                assert size == 1 and w[start] not in w[:start]
        assert at == len(w)


def test_z_values():
    assert periodic.z_values([]) == [] and periodic.z_values([1]) == [1] and periodic.z_values(list("aabaab")) == [6, 1, 0, 3, 1, 0]


def by_contract(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted((i, q, j - i) for i, j, q in slow_runs(words, 4, 6))
    gone = {x for i, q, n in found for x in range(i + q, i + n)}
    best = min(found, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(found), *four, sha("".join(f"{i},{n},{q}\n" for i, q, n in found)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_equals_brute_force(spark):
    found = QUERIES["op11_periodic_runs"](spark, TABLES)
    assert found.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    texts = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, found.collect())) == sorted(by_contract(r.doc_id, r.text) for r in texts)
    assert found.where("n_runs > 0").count() > 5


def test_periodic_runs_odd_rows(spark):
    docs = spark.createDataFrame([(None if i == 3 else 1, t, "r", 5) for i, t in enumerate(SEED_TEXTS)], "doc_id long, text string, runs string, period int")
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == len(SEED_TEXTS) and sum(r.doc_id is None for r in rows) == 1
    runs = {r.collapsed: [tuple(x) for x in r.runs] for r in rows}
    assert runs == {"": [], "a": [], "a b": [], "é": [(0, 40, 1)], "x y z": [(0, 600, 2)], "a" * 5000: [], "w": [(0, 3000, 1)]}
    assert periodic.periodic_runs(docs.limit(0)).count() == periodic.with_planted_periods(docs.limit(0)).count() == 0
    assert periodic.with_planted_periods(docs.where("doc_id is null")).first().text == "a"


def slow_windows(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    met = Counter(tuple(w[a : a + width]) for _, w in split for a in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = {x for a in range(len(w) - width + 1) if met[tuple(w[a : a + width])] > 1 for x in range(a, a + width)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=lambda r: (r[0] is None, r))


def summary(found):
    return sorted(((r.doc_id, r.n_words, sum(x.b - x.a for x in r.spans), sha(r.kept)) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_op12_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_word_windows"](spark, TABLES)
    assert found.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = slow_windows(texts, 35)
    assert sorted(map(tuple, found.collect())) == want and any(r[2] for r in want)


@pytest.mark.parametrize("most, width, size", [(2000, 5, 2), (3, 10, 10), (0, 8, 1)])
def test_windows_in_sorted_and_in_cut_buckets(spark, most, width, size):
    """A passage in most documents between changing words, exact copies, texts that repeat inside, repeated and null ids."""
    rng = random.Random(most)
    shared, few = [f"s{i}" for i in range(30)], [f"w{i}" for i in range(12)]
    rows = [(None if i % 4 == 0 else 1, t) for i, t in enumerate(SEED_TEXTS)]
    for i in range(50):
        rows.append((i // 2, " ".join(rng.choices(few, k=rng.randint(0, 60)) + (shared if i % 3 else []) + rng.choices(few, k=rng.randint(0, 60)))))
    rows += rows[-5:]
    docs = spark.createDataFrame([(i, t, 1, "k", b"") for i, t in rows], "doc_id long, text string, row int, key string, packed binary")
    want = sorted(slow_windows(rows, width), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert summary(windows.remove_windows(docs, width, size, most, 10)) == want


def test_a_text_alone_keeps_what_its_namesake_loses(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    docs = spark.createDataFrame([(1, x), (1, y), (3, x)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in windows.remove_windows(docs).collect()) == [(1, ""), (1, y), (3, "")]
    assert windows.remove_windows(docs.limit(0)).count() == 0


def test_equal_windows_have_equal_minimisers():
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    of = {}
    for first, end, key in zip(*(c.tolist() for c in windows.super_kmers(words, 6, 2))):
        for a in range(first, end):
            assert of.setdefault(tuple(words[a : a + 6]), key) == key
    assert [len(c) for c in windows.super_kmers(words[:5], 6, 2)] == [0, 0, 0]


def same_as_sql(found, db):
    order = ["part", "filter_order", "step"]
    one, two = (df[sorted(df.columns)].sort_values(order).reset_index(drop=True) for df in (found.toPandas(), db.sql(ORACLES["op13_filter_audit"]).df()))
    assert list(one.columns) == list(two.columns) and one.astype(str).equals(two.astype(str))
    return len(one)


def test_op13_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    assert same_as_sql(QUERIES["op13_filter_audit"](spark, TABLES), db) % 600 == 0


def test_filter_audit_odd_rows(spark):
    rows = [
        (1, None, None), (2, "", "en"), (None, "", "en"), (2, "", "fr"), (3, "A" * 50, "en"), (4, "A" * 50, None), (5, "# x " * 60, "en"), (6, "# x " * 60, "en"), (6, "# x " * 60, "de"),
        (None, "é" * 5, "de"), (7, " ".join(f"w{i}" for i in range(150)), "en"), (8, "　".join("AB"), "en"),
    ]
    marks = [(1, 1, 1), (1, 0, 0), (4, 1, None), (6, None, 1), (None, 1, 1), (7, 1, 1)]
    db = duckdb.connect()
    db.sql("create table documents(doc_id bigint, text varchar, lang varchar); create table labels(doc_id bigint, quality int, toxic int)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    db.executemany("insert into labels values (?, ?, ?)", marks)
    docs = spark.createDataFrame([(*r, "p", True) for r in rows], "doc_id long, text string, lang string, part string, A boolean")
    labels = spark.createDataFrame([(*r, "en") for r in marks], "doc_id long, quality int, toxic int, lang string")
    assert same_as_sql(audit.interactions(docs, labels), db) == 4 * 600
    assert audit.interactions(docs.limit(0), labels).count() == 0


def test_steps_cover_all_orders():
    plan = audit.steps()
    assert len(plan) == 600 and len({o for o, *_ in plan}) == 120 and all(after == before | 1 << "ABCDE".index(f) for _, _, f, before, after in plan)


def slow_bytes(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    met = Counter(r[a : a + length] for _, r in raws for a in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if met[r[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        out.append((i, len(r), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone))), sha(bytes(x for x, g in zip(r, gone) if not g))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def byte_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), sha(bytes(r.kept))) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("most", [500, 2])
def test_suffix_dedup_of_repeated_and_null_ids(spark, most):
    """A unique text keeps all, whoever shares its id; rows that are there twice lose all; null ids lose what repeats."""
    rng = random.Random(6)
    words = [f"w{i}é" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    x, y, passage = text(120), text(120), text(100)
    rows = [(1, x), (1, y), (3, x), (None, passage + text(50)), (None, text(40) + passage), (5, text(200)), (5, None), (6, ""), (7, "a" * 1000)]
    rows += [(i, text(30) + passage + text(30)) for i in range(10, 16)] + [rows[5]]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, key int")
    got = byte_rows(suffix.remove_repeats(docs, most=most))
    assert got == slow_bytes(rows, 400)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_op9_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op9_suffix"](spark, TABLES)
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect())) == slow_bytes(texts, 400)


def test_op7_fields(spark):
    """Every field of the contract from the payload, and the stored form read back as the payload; equal texts, equal rows."""
    want = {}
    for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want[r.doc_id] = (len(raw), len(p), sha(p), zlib.crc32(p[-16:]))
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in QUERIES["op7_media"](spark, TABLES).collect()}
    assert got == want
    docs = spark.createDataFrame([(1, "ab " * 3000), (2, "ab " * 3000), (None, None), (3, "")], "doc_id long, text string")
    rows = webp.media(docs).collect()
    assert all(sha(bytes(r.media)) == r.media_sha256 and len(r.media) == r.media_bytes for r in rows)
    assert len({r.media_sha256 for r in rows}) == 2 and rows[0].feature == rows[1].feature and webp.media(docs.limit(0)).count() == 0


def test_names_within_articles_that_merely_hold_a_word():
    page = """<body><nav>Home</nav><article><p>Opening words of the article, which are long enough to count here.</p>
      <section class="share-of-market"><p>Their share of the market rose, and it rose again.</p><p>More on shares follows, in full.</p></section>
      <div class="menu-planning advice"><p>Plan the menu a week ahead, she says, and shop but once.</p></div>
      <div class="promo-code_links-of-old"><a href="x">one link</a> <a href="y">another link</a></div>
      <div class="share-bar"><span>Share this</span></div><div id="comments"><p>First! I do not agree with a word of this, at all.</p></div></article></body>"""
    assert html.main_text(page) == (
        "Opening words of the article, which are long enough to count here. Their share of the market rose, and it rose again. More on shares follows, in full. "
        "Plan the menu a week ahead, she says, and shop but once."
    )
    assert [html.wholly_unlikely(n) for n in ("share-bar", "share-of-market", "x comments", "related_posts_2", "commentary")] == [True, False, True, True, False]


def test_equal_cuts_are_sorted_once():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 100, 40).astype(np.uint8)) for _ in range(6)]
    cuts = [b"".join(words[k] for k in rng.integers(0, 6, 3)) for _ in range(60)]
    owners, starts = rng.integers(0, 9, 60), rng.integers(0, 3, 60) * 7
    # a place holds one text, so equal places get equal cuts
    at = {}
    cuts = [at.setdefault((o, s), c) for o, s, c in zip(owners.tolist(), starts.tolist(), cuts)]
    apart = [o * 1000 + s for o, s in zip(owners.tolist(), starts.tolist())]
    got = suffix.repeated_cuts(cuts, np.array(apart), np.zeros(60, np.int64), 50)
    places = {}
    for c, o in zip(cuts, apart):
        for k in range(len(c) - 49):
            places.setdefault(c[k : k + 50], set()).add((o, k))
    assert [f.tolist() for f in got] == [[len(places[c[k : k + 50]]) > 1 for k in range(len(c) - 49)] for c in cuts]
    assert suffix.SCREEN == 5 and sum(f.sum() for f in got) > 0


def test_only_whole_strings_are_sorted_and_long_contexts_keep_theirs():
    """Contexts of many times the length, of few symbols, with copies of parts; suffixes wanted here and there."""
    rng = random.Random(8)
    for _ in range(400):
        length, few = rng.choice([3, 5, 8, 12]), rng.choice([1, 2, 3])
        pool = [bytes(rng.choices(range(97, 97 + few), k=rng.randint(0, 60))) for _ in range(5)]
        contexts = [rng.choice(pool)[rng.randint(0, 5) :] + rng.choice(pool) for _ in range(rng.randint(1, 6))]
        places = Counter(c[k : k + length] for c in contexts for k in range(len(c) - length + 1))
        want = [[places[c[k : k + length]] > 1 for k in range(len(c) - length + 1)] for c in contexts]
        got = suffix.repeated_strings(contexts, np.arange(len(contexts)), np.zeros(len(contexts), np.int64), length)
        assert [f.tolist() for f in got] == want
        text = np.frombuffer(b"\0".join(contexts), np.uint8)
        wanted = np.array([rng.random() < 0.3 for _ in text], bool)
        order = sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:].tobytes())
        assert suffix.suffix_array(text, wanted=wanted).tolist() == order

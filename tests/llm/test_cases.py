"""Cases in which rows, texts or columns could be lost, and queries held against libraries and brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import bpe, common, decontaminate, html, pieces, pii, suffix, toxicity

TABLES = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}


def test_redaction_goes_row_by_row(spark):
    rows = [(1, "a.b@c.de x", 10, "n"), (1, "nothing here", 12, None), (None, "mail a.b@c.de", 13, "n"), (2, None, None, "")]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _spans string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars, r._spans) for r in got if r.text) == [(0, "mail <EMAIL>", 12, "n"), (1, "<EMAIL> x", 9, "n"), (1, "nothing here", 12, None)]
    assert len(got) == 4 and [r for r in got if r.doc_id == 2][0].text is None


def test_relaxed_addresses_start_where_they_start(spark):
    text = "x" * 100 + " (at) example.com"
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert all(s.start == 0 for s in spans)


@pytest.mark.parametrize("most", [500_000, 0])
def test_each_text_of_a_repeated_item_is_searched_for(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    one, two = "what is the shortest way from the old harbour to the new town hall", "which of these four metals melts first when the oven is slowly heated"
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (2, None), (None, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {one} then"), (2, f"well, {two}."), (3, "nothing of the kind"), (3, None), (None, two)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 3]


def test_toxic_documents_go_whatever_the_columns(spark):
    docs = spark.createDataFrame([(i, "you are a stupid worthless idiot, you scum" if i % 5 == 0 else f"a calm text number {i}", 0.5, "s") for i in range(60)], "doc_id long, text string, score double, _score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 5}


def test_transducers_take_effect(spark):
    weigh = lambda t: sum(toxicity.Grammar({}).clauses(t))
    assert weigh("you idiot") > weigh("the idiot") > weigh("said idiot") == weigh('an "idiot"') > weigh("said not an idiot") > 0
    assert weigh("i will kill you") == 1.0 and weigh("i will not kill you") == weigh("i will kill time") == 0
    whole = toxicity.negation().compose(toxicity.speech()).compose(toxicity.directed())
    assert len(whole.ends) == 64 and whole.start == ((0, (False, False)), (False, False, 0))


def test_articles_keep_their_paragraphs():
    page = '<div id="comments-page"><article><p>Hello, this is an article of some length, yes.</p><p class="promo-code related-work">Second.</p><div class="share-bar">Share it</div></article></div>'
    assert html.main_text(page) == "Hello, this is an article of some length, yes. Second."
    page = '<div class="story"><article><p>One long paragraph, with commas, that makes up the article here.</p></article><div class="comments"><article><p>a reader, writing, at length, about it</p></article></div></div>'
    assert html.main_text(page) == "One long paragraph, with commas, that makes up the article here."
    for odd in ("<div>" * 30_000 + "x" + "</p>" * 30_000, "<a '" * 20_000, "<a '" * 20_000 + ">"):
        html.main_text(odd)  # ends soon


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "local-cluster[3,2,1000]"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_token_queries_equal_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = texts_of(spark)
    t, lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in bpe.op5_token_counts(spark, TABLES).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    for r in pieces.op6_sentencepiece(spark, TABLES).collect():
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_odd_chunks_equal_the_library():
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), cache=50)
    rng = random.Random(3)
    texts = ["", " ", "\n", "\n\n a\n", "▁x ▁▁", "a  b   c", "x\n y", " lead", "trail ", "é" * 50, "a" * 3000, "\x00\t日本", "n't 's!!!"] + ["".join(rng.choice("ab .,\n▁é日'!\t") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t, (ids, n, text) in zip(texts, p.many(texts)):
        want = p.lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want) and text == p.lib.decode(want)
    p.compare()


def brute_repeats(docs, length):
    places = {}
    for i, b in docs:
        for a in range(len(b) - length + 1):
            places.setdefault(b[a : a + length], []).append((i, a))
    out = {i: np.zeros(len(b), bool) for i, b in docs}
    for v in places.values():
        if len(v) > 1:
            for i, a in v:
                out[i][a : a + length] = True
    return out


def test_structured_bytes(spark):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rng = random.Random(9)
    passage = "".join(rng.choice("abc ") for _ in range(700))
    docs = [(1, morse), (2, morse[512:1600]), (3, "".join(rng.choice("ab") for _ in range(1500))), (4, passage + "z" * 500), (5, "y" + passage[100:] + "q"), (6, passage[:399] + "!"), (7, None), (8, "")]
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_repeats([(i, (t or "").encode()) for i, t in docs], 400)
    assert set(got) == set(want)
    for i, t in docs:
        assert bytes(got[i].kept) == bytes(np.frombuffer((t or "").encode(), np.uint8)[~want[i]])


def test_base_digest_equals_patterns(spark):
    texts = texts_of(spark)
    luhn = lambda d: sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for r in pii.op1_pii(spark, TABLES).collect():
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[r.doc_id]) if ok(m[0])] for k, (p, ok) in rules.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in found.values()]
        assert r.base_sha256 == hashlib.sha256(",".join(x for v in found.values() for x in v).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= {x for v in found.values() for x in v}

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, chat, common, linededup, lm, media, neardup, packing, pii, quality, urls, wordhash
from tests.llm.test_queries import near_by_brute_force, words
from tests.oracle import FOLDER

ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (4, "one two"), (5, "x" * 200_000), (6, "word " * 30_000), (None, "no id at all here")]


def test_word_hashes_follow_the_words():
    texts = ["Hello  world", None, "", "a" * 3_000_000 + " b", "ÄÖ é\x0bx", "hello WORLD"]
    hashes, counts = wordhash.words(pa.array(texts))
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert hashes[:2].tolist() == hashes[-2:].tolist() and len(set(hashes.tolist())) == len({w for t in texts for w in words(t, True)})
    assert wordhash.words(pa.array([], pa.string()))[1].tolist() == []


# ---- personal data ----------------------------------------------------------------------------


def test_base_rules_on_edges():
    spans = lambda t: [(k, t[s:e]) for k, s, e in pii.base_spans(t)]
    assert spans("b.c@d.e@f.g") == [("email", "b.c@d.e")]
    assert spans("a@@b.c @b.c@d.e") == [("email", "b.c@d.e")]
    assert spans("256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.1") == [("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "007.0.0.1")]
    assert spans("4111 1111 1111 1111 4111111111111112") == []  # one run of 32 digits
    assert ("card", "4111-1111-1111-1111") in spans("x4111-1111-1111-1111y")
    assert spans("+1 (743) 555-3824.") == [("phone", "+1 (743) 555-3824")] and pii.base_spans(None) == []


def test_model_on_held_out_labels_and_overlapping_windows():
    model = pii.default_model()
    labelled = pii.make_labelled(200, 4242)
    found = pii.find_spans([t for t, _ in labelled], model)
    hit = sum(len(set(g) & set(a)) for (_, g), (_, a) in zip(labelled, found, strict=True))
    assert hit / sum(len(g) for _, g in labelled) > 0.85 and hit / sum(len(a) for _, a in found) > 0.9
    for shift in range(0, 70, 7):  # the same span wherever windows cut it
        text = "w" * shift + " write to bob.smith42 [at] example [dot] com today " + "v" * 40
        assert [text[s:e] for k, s, e in pii.find_spans([text], model)[0][1] if k == "email"] in (["bob.smith42 [at] example [dot] com"], [])
    clean = ["In 2024 prices rose 12% to 143,000 (see [12]).", "Call me @home at 12:30", "v1.2.3"]
    assert all(not a for _, a in pii.find_spans(clean, model))


def test_crf_gradient_is_right():
    rng = np.random.default_rng(0)
    e, a, y = rng.standard_normal((2, 5, pii.TAGS)), rng.standard_normal((pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (2, 5))
    loss, d_e, d_a = pii._crf_gradient(e, a, y)
    for i in ((0, 1, 2), (1, 4, 0)):
        up = e.copy()
        up[i] += 1e-5
        assert (pii._crf_gradient(up, a, y)[0] - loss) / 1e-5 == pytest.approx(d_e[i], abs=1e-4)
    up = a.copy()
    up[1, 3] += 1e-5
    assert (pii._crf_gradient(e, up, y)[0] - loss) / 1e-5 == pytest.approx(d_a[1, 3], abs=1e-4)


def test_reconcile_keeps_the_best_set():
    assert pii.reconcile([(1.0, 0, 0, 10, False), (5.0, 1, 5, 15, False), (1.0, 0, 20, 30, True), (1.0, 0, 25, 40, True)]) == [(1, 5, 15), (0, 20, 40)]


def test_windows_left_out_change_nothing(spark, monkeypatch):
    """Against all windows, on the supplied documents and on texts full of spans and near misses."""
    texts = [r["text"] for r in common.table(spark, FOLDER, "documents").select("text").collect()] + [t for t, _ in pii.make_labelled(150, 99)]
    long_name, long_host = "q" * 70 + ".name", "h" * 90
    hidden = [f"{long_name} [at] {long_host} [dot] com", f"{long_name} @ {long_host} . co . uk", f"see {long_name}@ {long_host}. com now", "4111 - 1111 - 1111 - 1111", "x" * 300 + "@" + "y" * 300 + ".z", "1. 2. 3. " * 400, "words only " * 50]
    texts += [" ".join(["and"] * shift) + " " + h for h in hidden for shift in (0, 3, 7, 11)]
    model = pii.default_model()
    found = pii.find_spans(texts, model)
    monkeypatch.setattr(pii, "_starts", lambda t: list(range(0, max(1, len(t) - pii.STRIDE), pii.STRIDE)))
    assert found == pii.find_spans(texts, model) and sum(len(x) - len(b) for b, x in found) > 100


def test_reconcile_equals_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(60):
        pieces = [(float(rng.integers(1, 9)), int(rng.integers(0, 2)), int(s), int(s + rng.integers(1, 12)), False) for s in rng.integers(0, 30, 7)]
        spans = {(k, s, e): c for c, k, s, e, _ in sorted(pieces, key=lambda x: (x[1], x[2], x[3]))}
        sets = [[x for i, x in enumerate(spans) if bits >> i & 1] for bits in range(1 << len(spans))]
        best = max(sum(spans[x] for x in own) for own in sets if all(a == b or a[2] <= b[1] or b[2] <= a[1] for a in own for b in own))
        assert sum(spans[x] for x in pii.reconcile(pieces)) == best
    many = [(1.0, 0, 10 * i, 10 * i + 12, False) for i in range(60_000)]
    assert len(pii.reconcile(many)) == 30_000


def test_pii_edge_rows_and_redaction(docs):
    df = docs([*[(i, t, i) for i, t in ODD], (7, "mail a@b.co or +1 (743) 555-3824", 7)], ", n_email int")
    found = pii.detect(df).collect()
    assert len(found) == len(ODD) + 1 and all(r["spans"] == "" for r in found if r["doc_id"] != 7)
    left = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert left[7]["text"] == "mail [EMAIL] or [PHONE]" and left[7]["n_email"] == 7 and left[1]["text"] is None
    assert pii.detect(docs([])).count() == 0


# ---- packing ----------------------------------------------------------------------------------


def test_boundaries_equal_brute_force():
    """Lengths on both sides of 1,024, ties, and fewer lengths than buckets."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    for most in (12, 40, 5000, 3_000_000):
        own = rng.integers(1, most, 11)
        lengths, docs = np.unique(own, return_counts=True)
        for k in (1, 2, 3, 4, 20):
            best = min(
                (sum(min(b for b in (*c, int(lengths[-1])) if b >= n) - n for n in own.tolist()), c)
                for c in combinations(lengths[:-1].tolist(), min(k, len(lengths)) - 1)
            )
            bounds, padding = packing.best_boundaries(lengths, docs, k)
            assert padding == best[0] and sum(min(b for b in bounds if b >= n) - n for n in own.tolist()) == padding


def test_boundaries_of_many_lengths_equal_the_plain_programme():
    rng = np.random.default_rng(3)
    lengths = np.unique((rng.pareto(0.8, 1200) * 20).astype(int) + 1)
    docs = rng.integers(1, 50, len(lengths))
    d, t = np.cumsum(docs), np.cumsum(docs * lengths)
    best = lengths * d - t
    for k in range(1, 6):
        best = np.array([min(best[i] + lengths[j] * (d[j] - d[i]) - (t[j] - t[i]) for i in range(k - 1, j)) if j >= k else 0 for j in range(len(lengths))])
        assert packing.best_boundaries(lengths, docs, k + 1)[1] == best[-1]


def test_packing_fills_batches(docs):
    df = docs([(i, "w " * (i % 50)) for i in range(400)] + ODD)
    rows = packing.pack(df, buckets=4, budget=200, shard_rows=50).collect()
    assert len(rows) == 408 and all(r["n_tokens"] <= r["padded_tokens"] for r in rows)
    batches: dict = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), own in batches.items():
        most = max(1, 200 // own[0]["padded_tokens"])
        assert len(own) <= most and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len(own) == most or (bucket, batch + 1) not in batches
    assert packing.pack(docs([])).count() == 0
    wide = packing.pack(docs([(1, "a b", 5, 6), (None, None, 5, 6)], ", batch int, row int"))
    assert wide.columns == ["doc_id", "text", "row", "n_tokens", "bucket", "padded_tokens", "batch", "slot"] and {r["row"] for r in wide.collect()} == {6}
    spread = docs([(None, "w " * i) for i in range(60)]).select(packing.shard_of(F.col("doc_id"), packing.n_tokens(F.col("text")), 8).alias("s")).distinct()
    assert spread.count() > 4  # rows without an id don't share one shard


# ---- urls -------------------------------------------------------------------------------------


def test_url_rules_and_bloom(spark):
    pages = spark.createDataFrame([(1, "http://WWW.Example.com/en/x"), (2, "https://a.net/es/1?b=2&utm_source=q#f"), (3, None), (4, "no scheme"), (5, "http://spam.org/p/"), (5, "http://spam.org/p/"), (6, "x://h")], "page_id int, url string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    listed = spark.createDataFrame([("spam.org/p",), (None,), ("other.org",)], "canonical string")
    for most in (1 << 20, 0):  # broadcast and shuffled
        found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, listed, rules, max_broadcast_bytes=most).collect() if r["page_id"] != 3)
        assert found == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.net", "/es/1", "net/es/", "block"), (4, "", "", None, "allow"), (5, "spam.org", "/p/", None, "block"), (5, "spam.org", "/p/", None, "block"), (6, "h", "", None, "allow")]
    assert urls.filter_urls(pages.limit(0), listed, rules).count() == 0
    assert urls.filter_urls(pages, listed.limit(0), rules).where("listed").count() == 0
    wide = pages.selectExpr("*", "'x' host", "1 block", "true listed", "'q' verdict", "null canonical")
    assert sorted(map(str, urls.filter_urls(wide, listed, rules).collect())) == sorted(map(str, urls.filter_urls(pages, listed, rules).collect()))


def test_listed_urls_come_from_thin_pages_and_catch_other_spellings(spark):
    html = "<html><nav>a b c d e f</nav><article><p>{}</p></article></html>"
    short, long_ = html.format("only <b>three</b> words"), html.format("word " * 50)
    rows = [(1, "http://www.a.org/x/1.html", short), (2, "https://m.a.org/x/1/?utm_source=q#top", long_), (3, "https://a.org/x/2", long_), (4, "https://b.org/x/1", long_), (5, "https://b.org/y", "<p>no article</p>"), (6, None, short), (7, "https://b.org/z", None), (8, "https://A.org:443/x/1?page=2", long_)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    listed = urls.thin_urls(pages, 40)
    assert [r["canonical"] for r in listed.collect()] == ["a.org/x/1"]
    for most in (1 << 20, 0):
        found = urls.filter_urls(pages, listed, [], max_broadcast_bytes=most)
        assert {r["page_id"] for r in found.where("listed and verdict = 'block'").collect()} == {1, 2} and found.count() == len(rows)
    assert urls.filter_urls(pages, urls.thin_urls(pages, 1), []).where("listed").count() == 0
    long_url = spark.createDataFrame([(1, "https://a.org/" + "p" * 300_000 + "/?" + "&".join(f"k{i}=1" for i in range(20_000)), short)], "page_id int, url string, html string")
    assert urls.filter_urls(long_url, urls.thin_urls(long_url, 40), []).first()["verdict"] == "block"


def test_exact_join_removes_what_the_filter_lets_through(spark):
    """With three bits a key the filter alone would block pages that aren't listed; the rows are those of a plain lookup."""
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.org/{'p' * (i % 3)}/{i}") for i in range(3000)], "page_id int, url string")
    listed = urls.parsed(pages).where("page_id % 3 = 0").select("canonical")
    n_keys, bits = 1000, 3
    blocks = max(1, -(-n_keys * bits // (64 * urls.WORDS)))
    bloom = {r["block"]: r for r in urls.bloom_filter(listed, blocks).collect()}
    keyed = urls.parsed(pages).select("page_id", urls._block(F.col("canonical"), blocks).alias("block"), F.array(*urls._masks(F.col("canonical"))).alias("masks")).collect()
    passed = {r["page_id"] for r in keyed if all(bloom[r["block"]][f"w{i}"] & m for i, m in enumerate(r["masks"]))}
    expected = set(range(0, 3000, 3))
    assert expected < passed and len(passed) < 3000
    for most in (1 << 20, 0):
        found = urls.filter_urls(pages, listed, [], bits_per_key=bits, max_broadcast_bytes=most)
        assert {r["page_id"] for r in found.where("listed").collect()} == expected


# ---- media ------------------------------------------------------------------------------------


def test_transport_stream_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for size in (1, 2, 9, 10, 11, 79, 80, 81, 300):
        payload = rng.integers(0, 256, 192 * size).astype(np.uint8).tobytes()
        stream = media.mux(payload)
        found = media.demux(stream)
        assert found["payload"] == payload and found["continuity_errors"] == 0
        assert len(found["pts"]) == -(-size // 10) and found["random_access"][0]["pts"] == media.FIRST_PTS
    lost = stream[: 188 * 20] + stream[188 * 21 :]
    with pytest.raises(ValueError):
        media.demux(lost)
    assert media._demux(b"\0" * 188)["error"] == "sync byte is missing" and media._demux(None)["error"]


def test_media_edge_rows(docs):
    wide = media.media_of(docs([(1, "a", 5, None), (1, "a", 6, None)], ", media int, stream string")).collect()
    assert len(wide) == 2 and wide[0]["media"] == wide[1]["media"] and wide[0]["stream"]["error"] is None
    found = media.media_of(docs(ODD)).select("doc_id", "stream.error", F.length("stream.payload").alias("n")).collect()
    assert all(r["error"] is None and r["n"] % 192 == 0 and r["n"] for r in found)
    assert media.media_of(docs([])).count() == 0


# ---- language model ---------------------------------------------------------------------------


def test_scores_of_edge_rows(docs):
    found = lm.score(docs([*ODD, *[(i, "the cat sat on the mat") for i in range(10, 60)]])).collect()
    assert len(found) == len(ODD) + 50 and all(np.isfinite(r["score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    a, b = [r for r in found if r["doc_id"] == 4]
    assert a == b
    wide = lm.score(docs([(1, "a b", 5, 6, "x")], ", block int, fold int, score string")).first()
    assert wide["n_tokens"] == 3 and isinstance(wide["score"], float)
    assert lm.score(docs([])).count() == 0


def test_weights_are_learned():
    rows = np.array([[3, 40, 8, 900], [3, lm.NONE, 8, 100], [1, lm.NONE, 20, 500]])
    w = lm.learn_weights(rows)
    assert w[3, 0] > 0.7 and w[1, 0] < 0.01 and np.allclose(w.sum(1), 1) and w[0, 0] == 0
    assert lm.learn_weights(np.zeros((0, 4), np.int64)).tolist() == [[0, 0, 1]] * lm.BUCKETS


def test_every_bigram_counts(docs, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in (rng.pareto(0.35, 800) * 10).astype(int) % 90_000)) for i in range(200)]  # 160,000 tokens, many contexts seen once
    texts = {i: ["\0", *words(t, True), "\0"] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % lm.FOLDS for i in texts}

    def model(folds):
        own = [texts[i] for i in texts if fold[i] in folds]
        return Counter(w for t in own for w in t[1:]), Counter(p for t in own for p in zip(t, t[1:], strict=False))

    def bucket(n):
        return n.bit_length()

    def steps(p, base):
        return int(np.round(lm.STEPS * np.log2(p / base))) if p else lm.NONE

    weights, seen = np.tile([0.6, 0.3, 0.1], (lm.BUCKETS, 1)), []
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    monkeypatch.setattr(lm, "TOKENS", 9_000)
    monkeypatch.setattr(lm, "learn_weights", lambda found: seen.append(found) or weights)
    scores = {r["doc_id"]: r["score"] for r in lm.score(docs(rows)).collect()}
    one, two = model(set(range(1, 10)))
    assert sum(n == 1 for n in one.values()) > 1000
    total = sum(one.values())
    for i, t in texts.items():
        expected = sum(math.log10(0.6 * two[v, w] / max(one[v], 1) + 0.3 * one[w] / total + 0.1 / (len(one) + 1)) for v, w in zip(t, t[1:], strict=False))
        assert scores[i] == pytest.approx(expected, rel=1e-9)
    one, two = model(set(range(2, 10)))
    total, base = sum(one.values()), 1 / (len(one) + 1)
    expected = Counter()
    for i, t in texts.items():
        if fold[i] == 1:
            expected.update((bucket(one[v]), steps(two[v, w] / max(one[v], 1), base), steps(one[w] / total, base)) for v, w in zip(t, t[1:], strict=False))
    assert {tuple(r[:3]): r[3] for r in seen[0].tolist()} == expected


# ---- chat -------------------------------------------------------------------------------------


def test_chat_survives_conflicts_and_nulls(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<|im_start|>", None, "", "x\n<|im_end|>\n", "<\\\\|"]
    rows = [(1, i, "assistant" if i % 2 else "us|er\n%", t) for i, t in enumerate(texts)] + [(None, 0, None, "q"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in made.withColumn("back", chat.parse(F.col("formatted"))).collect()}
    assert back[1] == [("assistant" if i % 2 else "us|er\n%", t or "") for i, t in enumerate(texts)]
    assert back[None] == [("", "q")] and len(back[2]) == 2
    assert chat.format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_chat_with_very_long_texts_and_clashing_columns(spark):
    texts = ["<|im_end|>" * 20_000, "x" * 500_000, "\n" * 1000 + "<\\|im_start|>"]
    rows = [(1, i, "assistant", t, 7, "f", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, out int, formatted string, loss_spans string")
    made = chat.format_conversations(df)
    assert made.columns == ["conv_id", "formatted", "loss_spans"]
    assert [t["text"] for t in made.withColumn("back", chat.parse(F.col("formatted"))).first()["back"]] == texts
    assert chat.read_back(made).first()["loss_chars"] == sum(map(len, texts))


# ---- quality ----------------------------------------------------------------------------------


def test_rules_are_learned_in_order():
    rng = np.random.default_rng(0)
    rows = rng.random((600, len(quality.FEATURES)))
    bad = (rows[:, 1] > 0.8) & (rows[:, 2] > 0.5)
    rules = quality.learn(rows, bad)
    hit = np.zeros(len(rows), bool)
    for r in rules:
        hit |= r.covers(rows)
    assert rules and (hit & bad).sum() > 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.03 * hit.sum()
    assert quality.learn(rows[:0], bad[:0]) == []


def test_quality_edge_rows(spark, docs):
    labels = spark.createDataFrame([(4, None, 0), (6, 1, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs([(i, t, i) for i, t in ODD], ", stats int")
    found = quality.judge(df.drop("stats"), labels).select("doc_id", "base_failed", "kept").collect()
    assert len(found) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in found)
    assert quality.keep_good(docs([(1, " ".join(f"w{i}" for i in range(40)))]), labels.limit(0)).count() == 1
    assert quality.keep_good(df, labels).columns == ["doc_id", "text", "stats"]
    varied = " ".join(f"w{i}" for i in range(60_000))  # long, without repeated windows, then with one at its end
    counts = {r["doc_id"]: r["stats"]["n_repeat_words"] for r in quality.statistics(docs([(1, varied), (2, varied + " w0 w1 w2 w3 w4")])).collect()}
    assert counts == {1: 0, 2: 10}


# ---- BPE --------------------------------------------------------------------------------------


def test_bpe_on_spaces_and_long_pieces(docs):
    import random

    import tiktoken

    path, pattern = bpe.public_ranks()
    own = bpe.Codec(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(5)
    texts = ["", " ", "   ", "a \n b", "a\n \nb", "it's  'll", "a" * 5000, "ab" * 400, "x\u3000 y", "\x1c \x1c a", "日本語", "mississippi" * 40]
    texts += ["".join(random.choice(" \n\ta b.é1's") for _ in range(random.randint(1, 50))) for _ in range(500)]
    assert [own.encode(t) for t in texts] == [theirs.encode_ordinary(t) for t in texts]
    assert all(own.decode(own.encode(t)).decode() == t for t in texts)
    df = docs(ODD)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect()}
    assert all(back[i] == (t or "") for i, t in ODD)
    assert bpe.round_trip(docs([]), path, pattern).count() == 0


def test_rank_bitmap():
    bits = bpe.RankBitmap(50_000)
    for r in (40_000, 7, 63, 64):
        bits.add(r)
    seen = []
    while (r := bits.first()) >= 0:
        seen.append(r)
        bits.remove(r)
    assert seen == [7, 63, 64, 40_000]


# ---- near duplicates --------------------------------------------------------------------------


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"e{rng.integers(1 << 30)}" for w in base)


def test_near_duplicates_with_hot_groups(docs):
    """Copies by the dozen whose mutual similarity straddles the threshold, so that buckets are split."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(400)]
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.01, 0.016, 0.02]))) for i in range(120)]
    rows += [(200 + i, " ".join(base)) for i in range(40)] + [(300 + i, f"short {i % 3}") for i in range(9)]
    expected = near_by_brute_force(dict(rows))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows)).collect()}
    assert found == expected and len({c for _, c in found.values()}) > 4


@pytest.mark.parametrize(("percent", "n"), [(85, 10), (80, 8)])
def test_smallest_sets_that_differ_are_linked(docs, percent, n):
    rows = []
    for k in range(8):
        own = [f"t{k}w{i}" for i in range(n)]
        longer = [*own, "end"] if k % 2 else ["start", *own]
        rows += [(10 * k, " ".join(own)), (10 * k + 1, " ".join(longer)), (10 * k + 2, " ".join(own[:-1]))]
    expected = near_by_brute_force(dict(rows), percent)
    assert all(expected[10 * k + 1] == (n - 3, 10 * k) and expected[10 * k + 2] == (n - 5, 10 * k + 2) for k in range(8))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows), percent).collect()} == expected


@pytest.mark.parametrize("percent", [50, 67, 80, 85, 90, 100])
def test_near_equals_brute_force_on_random_sets(docs, percent):
    """Sets of 1 to 40 shingles, each with copies that have some words fewer or more."""
    rng = np.random.default_rng(percent)
    rows = []
    for k in range(40):
        own = [f"d{k}w{i}" for i in range(int(rng.integers(5, 45)))]
        for _ in range(4):
            a, b = (int(x) for x in rng.integers(0, 4, 2))
            changed = [w if rng.random() > 0.01 else "new" for w in own[a : len(own) - b]]
            rows.append((len(rows), " ".join(changed + ["more"] * int(rng.integers(0, 2)))))
    expected = near_by_brute_force(dict(rows), percent)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows), percent).collect()}
    assert found == expected and len({c for _, c in found.values()}) < len(rows)


def test_near_very_long_texts_and_common_passages(docs):
    """Texts of 20,000 words, and many texts that share half of their words but belong to no group."""
    rng = np.random.default_rng(8)
    long_ = [f"l{i}" for i in range(20_000)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, edited(rng, long_, 0.01)) for i in range(6)] + [(10, " ".join(long_))]
    rows += [(100 + i, " ".join([*passage, *[f"own{i}x{k}" for k in range(14)]])) for i in range(80)]
    expected = near_by_brute_force(dict(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows)).collect()} == expected


def test_units_meet_every_pair(spark, docs, monkeypatch):
    """All links between components of a bucket are found, by clusters and by buckets, in blocks of a few sets."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(200)]
    texts = {i: edited(rng, base, rng.choice([0.002, 0.01, 0.02])) for i in range(50)}
    sketches = common.stored(neardup.sketch(docs(list(texts.items()))), "t")
    ids = {bytes(r["set"]): r["doc_id"] for r in sketches.collect()}
    classes = common.stored(sketches.select("set", "doc_id", F.col("n_shingles").alias("n"), "registers"), "t")
    component = {i: i // 7 for i in texts}  # made up: six sets each
    buckets = [range(0, 50)], [range(0, 20), range(15, 35), range(30, 50)]
    for own in buckets:
        rows = [(b, s, str(component[i]).encode()) for b, r in enumerate(own) for s, i in ids.items() if i in r]
        members = common.stored(spark.createDataFrame(rows, "bucket long, set binary, component binary"), "t")
        links = {tuple(sorted((ids[bytes(r["a"])], ids[bytes(r["b"])]))) for r in neardup.across(members, classes, docs(list(texts.items())), 85, 5).collect()}
        sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
        wanted = {(component[i], component[j]) for r in own for i in r for j in r if {i, j} <= set(ids.values()) and component[i] < component[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}

        def closure(pairs):
            parent = {c: c for c in component.values()}
            for a, b in sorted(pairs):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = {c: new if p == old else p for c, p in parent.items()}
            return parent

        assert all(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i, j in links)
        assert wanted and closure({(component[i], component[j]) for i, j in links}) == closure(wanted)


def test_memory_of_a_block_is_bounded():
    """Sets of 20,000 shingles that are shared by twos: the matrix is held in parts."""
    import tracemalloc

    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) for _ in range(16)]
    sets = [s for a in sets for s in (a, np.concatenate([a[: int(len(a) * 0.95)], rng.integers(0, 2**63, 500, dtype=np.uint64)]))]
    tracemalloc.start()
    found = neardup.pairs_across(np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(len(sets)), 85)
    assert sorted(found) == [(2 * i, 2 * i + 1) for i in range(16)] and tracemalloc.get_traced_memory()[1] < 160 << 20
    tracemalloc.stop()


def test_near_edge_rows(docs):
    df = docs([(i, t, i) for i, t in ODD], ", set long")
    found = neardup.near_duplicates(df.drop("set")).collect()
    assert len(found) == len(ODD)
    assert all(r["kept"] for r in found) and {r["n_shingles"] for r in found if r["doc_id"] == 6} == {1}
    assert neardup.drop_near(df).columns == ["doc_id", "text", "set"] and neardup.drop_near(df).count() == len(ODD)
    assert neardup.near_duplicates(docs([])).count() == 0


def test_sketches_estimate_and_collide():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (850, 75, 75))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    r = neardup.registers_of(np.concatenate([x, y]), np.array([925, 925]))
    estimate, possible = neardup.could_reach(r[:1], r[1:], np.array([925.0]), np.array([925.0]), 85)
    assert abs(estimate[0] - 0.85) < 0.12 and possible[0]
    union = neardup.registers_of(np.unique(np.concatenate([x, y])), np.array([1000]))
    assert (union[0] == np.maximum(r[0], r[1])).all()  # mergeable
    far = neardup.registers_of(np.concatenate([a, b]), np.array([75, 75]))
    assert not neardup.could_reach(far[:1], far[1:], np.array([75.0]), np.array([75.0]), 85)[1][0]


# ---- lines ------------------------------------------------------------------------------------


def test_recurring_templates_go_but_one(docs):
    boiler = "Order {} was shipped from the main warehouse on time"
    rows = [(i, f"unique text number{chr(97 + i)} stays\n{boiler.format(i)}\nbye{chr(97 + i)} now") for i in range(12)]
    rows += [(100 + i, "a copy of one text\nthat exists many times") for i in range(20)]
    left = {r["doc_id"]: r for r in linededup.drop_lines(docs(rows)).collect()}
    assert "Order 0" in left[0]["text"] and left[0]["dropped"] == []
    assert all("Order" not in left[i]["text"] and left[i]["dropped"] == [1] and left[i]["text"].count("\n") == 1 for i in range(1, 12))
    assert all(left[100 + i]["dropped"] == [] for i in range(20))
    copies = {r["doc_id"]: r["dropped"] for r in linededup.drop_lines(docs([*rows, (50, rows[0][1]), (51, rows[3][1])])).collect()}
    assert copies[50] == copies[0] == [] and copies[51] == copies[3] == [1]  # copies stay copies


def test_a_text_counts_once_however_often_it_has_a_template(docs):
    """Ten texts share a template; four of them have it twice with a shared word at the variable place."""
    line = "the order of {} was shipped from the main warehouse on time"
    texts = [f"own{chr(97 + i)} text\n{line.format('x' + chr(97 + i))}" + (f"\n{line.format('shared')}" if i < 4 else "") for i in range(10)]
    left = linededup.drop_lines(docs(list(enumerate(texts)))).collect()
    assert sum(len(r["dropped"]) for r in left) == 12 and all(len(r["text"].split()) == (2 if r["doc_id"] else 26) for r in left)
    fewer = linededup.drop_lines(docs(list(enumerate(texts[:7])))).collect()
    assert all(r["dropped"] == [] for r in fewer)


def test_fields_and_long_lines(docs):
    """Words with digits match anything; long lines recur from two texts on, as long as no word differs."""
    rows = [(i, f"own{chr(97 + i)} text\nPage {i} of 10\nCopyright 2024 Acme Ltd\n12 {i}") for i in range(9)]
    left = {r["doc_id"]: r["dropped"] for r in linededup.drop_lines(docs(rows)).collect()}
    assert left == {0: [], **{i: [1, 2] for i in range(1, 9)}}
    passage = " ".join(f"p{i}q" if i % 7 == 3 else "p" + "abcdefghij"[i % 10] * (i + 1) for i in range(55))
    rows = [(1, f"one\n{passage}"), (2, f"two\n{passage}\nmore"), (3, f"three\n{passage} end"), (4, f"four\n{passage.replace('p3q', 'p4q')}"), (None, f"five\n  {passage}"), (6, f"six\n{' '.join(passage.split()[:49])}"), (7, f"7\n{' '.join(passage.split()[:49])}")]
    left = {r["doc_id"]: r["dropped"] for r in linededup.drop_lines(docs(rows)).collect()}
    assert left == {1: [], 2: [1], 3: [], 4: [], None: [1], 6: [], 7: []}
    assert all(r["dropped"] == [] for r in linededup.drop_lines(docs([(i, passage) for i in range(20)])).collect())


def test_line_edge_rows(docs):
    df = docs([(i, t, i, 7, 8) for i, t in ODD], ", place int, dropped int, gone int")
    same = linededup.keep_distinct(df)
    assert same.columns == df.columns and sorted(map(str, same.collect())) == sorted(map(str, df.collect()))
    left = linededup.drop_lines(df).collect()
    assert len(left) == len(ODD) and {r["text"] for r in left} == {t for _, t in ODD}
    assert linededup.drop_lines(docs([])).count() == 0

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tallyhouse.llm import common
from tallyhouse.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.oracle import FOLDER, check

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return [w for w in SPLIT.split(text.translate(LOWER) if lower else text) if w]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def documents(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, FOLDER, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_op1_base_equals_plain_patterns(spark):
    from tallyhouse.llm import pii

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, piece):
        digits = re.sub("[^0-9]", "", piece)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in piece.split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    texts = documents(spark)
    found = {r["doc_id"]: r for r in QUERIES["op1_personal_data"](spark, FOLDER).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        base = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if fine(k, m[0])]
        r = found[i]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [r[f"n_{k}"] for k in patterns] == [sum(b[0] == k for b in base) for k in patterns]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


def test_op4_round_trip(spark):
    texts = documents(spark)
    for r in QUERIES["op4_media_ts"](spark, FOLDER).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] % 188 == 0 and "cc_errors=0" in r["feature"]


def test_op4_media_by_a_plain_reader(spark):
    from tallyhouse.llm import media

    found = {r["doc_id"]: r for r in QUERIES["op4_media_ts"](spark, FOLDER).collect()}
    docs = common.table(spark, FOLDER, "documents").select("doc_id", "text")
    for r in media.media_of(docs).select("doc_id", "text", "media").collect():
        stored, told = found[r["doc_id"]], bytes(r["media"])
        raw = r["text"].encode()
        payload, feature = brute.stream_of(told)
        assert payload == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (stored["media_bytes"], stored["media_sha256"], stored["feature"]) == (len(told), sha(told), feature)


def test_op5_base_scores(spark):
    texts = {i: [*words(t, True), "\0"] for i, t in documents(spark).items()}
    train = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, kinds = sum(train.values()), len(train)
    found = QUERIES["op5_deleted_interpolation"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        own = texts[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op7_counts(spark):
    texts = documents(spark)
    for r in QUERIES["op7_quality_rules"](spark, FOLDER).collect():
        text = texts[r["doc_id"]] or ""
        own = words(text)
        windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(own) < 10 or 100 * len(covered) > 20 * len(own))
        assert not (r["kept"] and r["base_failed"])


def test_op7_verdicts_are_those_of_the_rules(spark):
    rules = brute.rules_of(spark, FOLDER)
    texts = documents(spark)
    found = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_rules"](spark, FOLDER).collect()}
    assert rules and found == {i: brute.is_kept(t, rules) for i, t in texts.items()}


def test_op10_equals_brute_force(spark):
    texts = documents(spark)
    left = brute.lines_left(texts)
    found = {r["doc_id"]: (r["n_dropped"], r["text_sha256"]) for r in QUERIES["op10_line_dedup"](spark, FOLDER).collect()}
    assert found == {i: ((texts[i] or "").count("\n") - (left[i] or "").count("\n") if left[i] or not texts[i] else found[i][0], sha(left[i] or "")) for i in texts}


def test_op8_equals_the_library(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = documents(spark)
    for r in QUERIES["op8_bpe_round_trip"](spark, FOLDER).collect():
        text = texts[r["doc_id"]] or ""
        ids = theirs.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def near_by_brute_force(texts, percent=85):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t, True)) else set() for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op9_equals_brute_force(spark):
    expected = near_by_brute_force(documents(spark))
    found = {r["doc_id"]: r for r in QUERIES["op9_near_duplicates"](spark, FOLDER).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())

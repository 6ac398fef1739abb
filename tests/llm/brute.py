"""Plain Python versions of operators, written from their contracts and not from their code."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from tallyhouse.llm import linededup, packing, quality

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


def statistics(text):
    """Counts and the features that quality rules may test."""
    text = text or ""
    own, lines = words(text), [x for x in text.split("\n") if words(x)]
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = len({i + k for i, w in enumerate(windows) if w in twice for k in range(5)})
    chars, n, n_lines = sum(map(len, own)), len(own), len(lines)

    def share(a, b):
        return a / b if b else 0.0

    def count(characters):
        return sum(text.count(c) for c in characters)

    features = {
        "mean_word": share(chars, n), "symbols_per_word": share(count("#*$%&|<>"), n), "repeat_share": share(repeated, n), "dup_line_share": share(n_lines - len(set(lines)), n_lines), "upper_share": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
        "bang_per_word": share(count("!"), n), "comma_per_word": share(count(",;"), n), "digit_share": share(count("0123456789"), chars), "words_per_line": share(n, n_lines),
    }
    return {"n_words": n, "n_repeat_words": repeated} | features


def is_kept(text, rules):
    """Base rules, then the decision list in order."""
    s = statistics(text)
    if s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]:
        return False
    return not any(all(s[name] <= t if below else s[name] > t for name, below, t in r.conditions) for r in rules)


def rules_of(spark, folder):
    from tallyhouse.llm import common

    return quality.learn(*quality.labelled(common.table(spark, folder, "documents").select("doc_id", "text"), common.table(spark, folder, "labels")))


def lines_left(texts):
    """Text of each document (doc_id -> text) without the lines of recurring templates."""
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    held, bearers, whole = {}, defaultdict(set), defaultdict(set)
    for t in first:
        held[t] = []
        for line in (t or "").split("\n"):
            own = words(line)
            masked = [linededup.VARIABLE if re.search("[0-9]", w) else w for w in own]
            leaf = (len(own), *masked[:3])
            held[t].append((line, own, masked, leaf))
            for at, w in enumerate(masked):
                bearers[leaf, at, w].add(t)
            if len(own) >= 50:
                whole[tuple(own)].add(t)
    templates = defaultdict(set)

    def template(masked, leaf):
        fixed = [(at, w) for at, w in enumerate(masked) if w != linededup.VARIABLE and len(bearers[leaf, at, w]) >= 8]
        fields = masked.count(linededup.VARIABLE)
        fits = 100 * len(fixed) >= 80 * (len(masked) - fields) and len(fixed) >= (2 if fields else 1)
        return (leaf, *fixed) if fits else None

    for t, lines in held.items():
        for _, own, masked, leaf in lines:
            if own and (key := template(masked, leaf)):
                templates[key].add(t)

    def goes(t, own, masked, leaf):
        key = template(masked, leaf) if own else None
        groups = [templates[key]] if key and len(templates[key]) >= 8 else []
        groups += [g] if len(g := whole.get(tuple(own), ())) >= 2 else []
        return any(t != min(g, key=first.__getitem__) for g in groups)

    kept = {t: None if t is None else "\n".join(line for line, *rest in lines if not goes(t, *rest)) for t, lines in held.items()}
    return {i: kept[t] for i, t in texts.items()}


def packed(texts):
    """doc_id -> (n_tokens, bucket, padded_tokens, batch, slot) with the plain dynamic programme."""
    length = {i: len(words(t)) + 1 for i, t in texts.items()}
    sizes = sorted(set(length.values()))
    docs = Counter(length.values())
    d, t = [0], [0]
    for n in sizes:
        d.append(d[-1] + docs[n])
        t.append(t[-1] + n * docs[n])
    best, came = [n * d[j + 1] - t[j + 1] for j, n in enumerate(sizes)], []
    for k in range(1, min(packing.BUCKETS, len(sizes))):
        step = [min((best[i] + sizes[j] * (d[j + 1] - d[i + 1]) - (t[j + 1] - t[i + 1]), i) for i in range(k - 1, j)) if j >= k else (0, 0) for j in range(len(sizes))]
        best, back = [c for c, _ in step], [i for _, i in step]
        came.append(back)
    ends = [len(sizes) - 1]
    for back in reversed(came):
        ends.append(back[ends[-1]])
    bounds = [sizes[e] for e in reversed(ends)]
    shards = max(1, -(-len(texts) // packing.SHARD_ROWS))
    bucket = {i: next(b for b, most in enumerate(bounds) if n <= most) for i, n in length.items()}
    shard = {i: int(hashlib.md5(f"{i}:{n}".encode()).hexdigest()[:8], 16) % shards for i, n in length.items()}
    out, seen = {}, Counter()
    for i in sorted(texts, key=lambda i: (bucket[i], shard[i], length[i], i)):
        b = bucket[i]
        size = max(1, packing.BUDGET // bounds[b])
        out[i] = (length[i], b, bounds[b], seen[b] // size, seen[b] % size)
        seen[b] += 1
    return out


def stream_of(media):
    """What a plain reader finds in a transport stream, packet by packet."""
    payload, pts, rap, pes, clocks, counters, errors = b"", [], [], b"", 0, {}, 0
    tables = {}

    def finish(unit):
        nonlocal payload
        assert unit[:3] == b"\0\0\1" and int.from_bytes(unit[4:6], "big") + 6 == len(unit) and unit[7] & 0x80
        s = unit[9:14]
        pts.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1)
        payload += unit[9 + unit[8] :]

    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, start, control = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3
        body, flags = 4, 0
        if control & 2:
            flags = p[5] if p[4] else 0
            body = 5 + p[4]
        if control & 1:
            if pid in counters:
                errors += (counters[pid] + 1) % 16 != p[3] & 15
            counters[pid] = p[3] & 15
        if start and pid in (0, tables.get("pmt")):
            section = p[body + 1 + p[body] :]
            size = 3 + ((section[1] & 15) << 8 | section[2])
            crc = 0xFFFFFFFF
            for byte in section[:size]:
                for bit in range(7, -1, -1):
                    crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (crc >> 31) ^ (byte >> bit & 1) else 0)
            assert crc == 0
            if pid == 0:
                tables["pmt"] = (section[10] & 0x1F) << 8 | section[11]
            else:
                info = 12 + ((section[10] & 15) << 8 | section[11])
                tables["type"], tables["es"] = section[info], (section[info + 1] & 0x1F) << 8 | section[info + 2]
        elif pid == tables.get("es"):
            clocks += bool(flags & 0x10)
            if start:
                if pes:
                    finish(pes)
                if flags & 0x40:
                    rap.append((len(pts), at))
                pes = b""
            pes += p[body:]
    finish(pes)
    points = ",".join(f"{pts[n]}@{at}" for n, at in rap)
    told = f"pmt={tables['pmt']} es={tables['es']} type={tables['type']} packets={len(media) // 188} cc_errors={errors} pcr={clocks} pes={len(pts)} pts={pts[0]}..{pts[-1]} rap={points}"
    return payload, told
